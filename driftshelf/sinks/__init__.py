"""Exports and the published tables."""
