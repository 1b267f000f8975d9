"""Operators for building training data from a document corpus."""
