"""Composed flows and the mapping of table roles onto the provided tables."""
