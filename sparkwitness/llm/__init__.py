"""Operators of a training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage.  Each module is one operator with a general
interface; ``registry`` holds the registered queries and their SQL.
"""
