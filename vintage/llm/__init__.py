"""Operators for training-data pipelines: ten operators, their queries and
SQL. Nothing else in the library imports this subpackage."""
