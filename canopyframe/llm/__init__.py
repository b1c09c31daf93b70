"""Operators and queries of the training-data pipeline; nothing else in the library imports this."""
