"""The detection, reassembly, metering, scoring and counting jobs on Structured Streaming."""
