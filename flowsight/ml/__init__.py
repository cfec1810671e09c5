"""Training, calibration, model selection and scoring with Spark ML."""
