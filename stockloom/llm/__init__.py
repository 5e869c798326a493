"""Operators for building training data; their queries are in ``queries``."""
