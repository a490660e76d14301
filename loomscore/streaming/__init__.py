"""Streaming of the dialogue-evaluation engine."""
