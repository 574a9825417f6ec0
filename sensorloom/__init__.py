"""Station telemetry to model-ready tables, written as lazy Spark DataFrame functions."""
