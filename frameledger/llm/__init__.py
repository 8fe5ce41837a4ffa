"""Operators for training-data corpora, and their registered queries."""
