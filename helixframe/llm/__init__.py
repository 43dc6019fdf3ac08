"""Operators for training-data pipelines. `registry` has their queries and SQL."""
