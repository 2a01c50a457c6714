"""Operators for the preparation of language-model training data. Nothing outside this package imports it."""
