"""Operators of a training-data pipeline: splits, percentiles, packing, mixing, sentences."""
