"""Streaming of the note graph."""
