"""Operators for building training data from large text tables; nothing else in the library imports this."""
