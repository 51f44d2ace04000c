"""Training-data operators: thirteen stand-alone Spark jobs over ``documents`` and its sister tables.

Nothing outside this subpackage imports it; the queries are in ``queries`` and their
DuckDB twins in ``sql``.
"""
