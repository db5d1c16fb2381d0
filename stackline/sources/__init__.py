"""Sources of the holdings engine."""
