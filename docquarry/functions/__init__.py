"""Scalar functions: of Columns, giving Columns."""
