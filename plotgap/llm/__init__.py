"""Operators of a large-scale training-data pipeline. Nothing outside this folder imports it."""
