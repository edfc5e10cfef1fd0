"""Readers of bibliography exports and document packages."""
