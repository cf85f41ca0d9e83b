"""Operators that prepare training data: deduplication, filters, classifiers and mixing."""
