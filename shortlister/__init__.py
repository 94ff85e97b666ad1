"""Catalogue ranking and evaluation on Spark DataFrames."""
