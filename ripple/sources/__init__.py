"""Readers, writers and the adapter over the shared test tables."""
