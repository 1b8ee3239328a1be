"""Sources of the spatial engine."""
