"""umbra: urban shade analytics as Spark DataFrames."""
