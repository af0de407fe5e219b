"""Operators of a training-data pipeline, each written on Spark jobs.

Nothing outside this package imports it; ``rowsift.llm.queries`` registers the
queries that the driver entry adds when the package is present.
"""
