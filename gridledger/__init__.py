"""Spark-native electricity-market and contract-risk analytics.

Every public operator takes DataFrames (or Columns) plus keywords and returns a
DataFrame (or Column); nothing here starts a session or runs an action unless
its docstring says so.
"""
