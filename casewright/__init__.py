"""casewright: case-text retrieval and evaluation analytics on Spark DataFrames."""
