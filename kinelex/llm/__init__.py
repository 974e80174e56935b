"""Training-data operators (language id, dedup, mixing, sharding, ...) on DataFrames.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries
when it is present.
"""
