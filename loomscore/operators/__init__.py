"""Operators of the dialogue-evaluation engine."""
