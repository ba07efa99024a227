"""brandloom: creator/brand partnership analytics on Spark DataFrames."""
