"""Operators of the holdings engine."""
