"""Plans of the note graph."""
