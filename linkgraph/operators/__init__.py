"""Operators of the note graph."""
