"""Functions of the dialogue-evaluation engine."""
