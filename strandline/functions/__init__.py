"""Scalar functions: JSON payloads, text, ranking."""
