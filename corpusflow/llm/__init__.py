"""Operators and a pipeline for training data; nothing else in the package imports them."""
