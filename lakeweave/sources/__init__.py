"""Readers and writers of lake data beside plain Parquet."""
