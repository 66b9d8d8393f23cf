"""Operators of a training-data pipeline over text tables.

Nothing else in the library imports this sub-package. It may import the general helpers of the library.
"""
