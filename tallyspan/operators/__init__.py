"""Operators over generic roles; every function maps DataFrames to DataFrames."""
