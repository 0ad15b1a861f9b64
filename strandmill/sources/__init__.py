"""Readers of external files and of the parquet tables."""
