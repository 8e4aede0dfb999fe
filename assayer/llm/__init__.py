"""Operators of a training-data pipeline: tokens, duplicates, classifiers, packing."""
