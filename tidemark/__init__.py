"""Market microstructure features and data preparation as Spark DataFrame jobs."""
