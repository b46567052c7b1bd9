"""Functions of the note graph."""
