"""Operators of a training-data pipeline: dedup, decontamination, tokens, classifiers, search."""
