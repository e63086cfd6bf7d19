"""Labelling of entries that arrive as a stream."""
