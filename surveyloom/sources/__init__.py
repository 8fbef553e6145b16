"""Readers, writers, and the run layout."""
