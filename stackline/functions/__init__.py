"""Functions of the holdings engine."""
