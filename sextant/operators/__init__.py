"""Operators over DataFrames: search, indexes, quantization, ranking, embedding."""
