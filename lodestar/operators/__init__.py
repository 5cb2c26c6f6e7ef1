"""Relational operators over frames of vectors and metadata."""
