"""Corpuscope: bibliometrics and tech mining on Spark DataFrames.

A corpus is a DataFrame with one row per document and multi-valued attributes
held as ``ARRAY<STRING>`` columns.  Every analysis is a function from DataFrames
to a DataFrame, so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
