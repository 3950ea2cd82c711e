"""Operators for training data: each takes and returns DataFrames of documents."""
