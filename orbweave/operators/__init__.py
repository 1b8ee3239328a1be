"""Operators of the spatial engine."""
