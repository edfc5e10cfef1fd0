"""Derived views over the driver tables."""
