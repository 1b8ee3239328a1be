"""Streaming of the spatial engine."""
