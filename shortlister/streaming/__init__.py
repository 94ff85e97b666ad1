"""Incremental evaluation of records that arrive as files."""
