"""Kinfold: exact and near duplicates of files and records, on Spark DataFrames."""
