"""tessera: a PySpark-native relational analytics engine.

A comprehension-style query builder over DataFrames, recursive relations, durable and in-memory relation
variables, and general data-cleaning operators. Everything compiles to DataFrame / SQL plans.
"""
