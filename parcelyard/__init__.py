"""Parcel-forwarding warehouse analytics as Spark DataFrame functions.

``operators`` holds the set-based reads, ``plans`` the batch change jobs,
``sources`` the readers and writers, ``functions`` the column expressions.
Every table carries ``tenant_id`` and every key and join includes it.
"""
