"""Incremental runs over arriving catalog files."""
