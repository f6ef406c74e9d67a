"""A relational language of weighted binary relations on Spark DataFrames."""
