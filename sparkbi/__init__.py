"""Spark-first table preparation, exploration and publishing.

Every operator takes DataFrames and returns a lazy DataFrame. See README.md for
the map from tasks to modules.
"""
