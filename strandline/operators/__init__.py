"""Relational and nested-data operators; each takes and returns DataFrames."""
