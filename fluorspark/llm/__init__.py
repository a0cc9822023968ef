"""Operators of a large-scale training-data pipeline, each one a Spark job."""
