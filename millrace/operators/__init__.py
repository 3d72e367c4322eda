"""Cleaning steps over DataFrames."""
