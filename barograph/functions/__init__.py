"""Column expressions: all built from Spark's own functions, none is a Python UDF."""
