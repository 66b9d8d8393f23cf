"""Spark engine for ordered post timelines and leakage-safe evaluation.

Sub-packages

``functions``  column expressions (no shuffle of their own)
``operators``  DataFrame-in, DataFrame-out building blocks
``sources``    readers and writers
``plans``      named queries over the driver tables, each with DuckDB SQL where SQL can say it
"""

__version__ = "0.1.0"
