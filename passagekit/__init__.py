"""Vessel-passage analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and only builds a plan; the
functions that run a job are the ones whose name says so (``write_*``,
``append_*``, ``delete_*``, ``deploy_*``).
"""
