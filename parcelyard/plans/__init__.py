"""Batch change jobs: ``job(tables, changes) -> changed tables``.

``tables`` maps table names to DataFrames. A job returns the new state of the
tables it touches and leaves writing to the caller.
"""
