"""slatewise: a Spark-first engine for candidate recommendation tables.

Every operator is a function from DataFrames to a DataFrame, made of native
Spark expressions wherever those can say it.
"""
