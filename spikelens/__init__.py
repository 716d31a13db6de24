"""Event-intelligence operators for Spark: DataFrames in, DataFrames out."""
