"""Readers and writers of the catalogue and its results."""
