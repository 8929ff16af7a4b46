"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; Spark partitions and shuffles the work, and Python inside tasks
handles one Arrow batch or one bounded group at a time.
"""
