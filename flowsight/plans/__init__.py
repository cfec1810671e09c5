"""Ready-made dataflows built from the operators."""
