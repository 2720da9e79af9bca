"""Metric forensics on Spark: did this metric really move, and why?

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
Nothing runs until the caller acts, except where a docstring says otherwise.
"""
