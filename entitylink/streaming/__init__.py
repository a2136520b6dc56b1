"""Mapping of streams, row by row and without state."""

from .rows import map_labels

__all__ = ["map_labels"]
