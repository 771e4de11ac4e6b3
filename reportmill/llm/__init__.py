"""Operators for preparing language-model training data, independent of the report engine."""
