"""Column functions of the signal engine."""
