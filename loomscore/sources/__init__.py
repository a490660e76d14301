"""Sources of the dialogue-evaluation engine."""
