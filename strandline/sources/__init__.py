"""Readers of compressed session logs."""
