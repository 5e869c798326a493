"""Readers, writers and the adapter for the supplied tables."""
