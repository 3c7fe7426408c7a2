"""Whole commands, and the queries over derived alignments."""
