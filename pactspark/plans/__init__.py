"""Composite plans."""
