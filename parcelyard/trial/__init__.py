"""The warehouse tables and requests derived from the driver's test tables.

The mappings are plain SQL that Spark and DuckDB both read, so that both engines
start from the same rows; what the library computes on them is never shared.
"""
