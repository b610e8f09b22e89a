"""Operators on DataFrames of codes, pairs and scores."""
