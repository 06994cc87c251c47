"""The jobs. Each takes DataFrames and returns DataFrames; none starts a Spark action."""
