"""shortlist: measure how well ranked candidate lists recover a known target, on Spark.

Every operator is a function from DataFrames to a DataFrame.  Sub-packages:

``functions``  column expressions (hash order, bands, features, tokens, statistics)
``operators``  relational operators built from those expressions
``sources``    readers and writers, and the standard views over a table directory
``plans``      whole jobs composed of operators
``streaming``  Structured Streaming jobs
``catalog``    the registered queries with their plain-SQL twins
"""
