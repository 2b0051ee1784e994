"""Project-intelligence analytics over Spark DataFrames."""
