"""Hunkwise: code-change risk analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function over Spark's own
expressions, so batch and streaming jobs share the same code.
"""
