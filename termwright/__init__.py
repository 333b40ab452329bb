"""Definition-gated analytics over Spark DataFrames."""
