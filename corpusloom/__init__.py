"""Corpus curation, leakage audit and paired evaluation as PySpark DataFrame operators."""
