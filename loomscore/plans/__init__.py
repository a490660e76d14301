"""Plans of the dialogue-evaluation engine."""
