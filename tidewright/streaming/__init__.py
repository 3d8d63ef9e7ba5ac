"""Operators on streams of readings."""
