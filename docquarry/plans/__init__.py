"""Registered queries: each applies operators to the given tables, beside the SQL of the same result."""
