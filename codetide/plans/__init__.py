"""Whole-table queries: each applies an operator to the star-schema tables, with SQL to hold it against."""
