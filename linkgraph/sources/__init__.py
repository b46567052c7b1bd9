"""Sources of the note graph."""
