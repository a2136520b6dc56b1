"""Adapters from index tables to raw lookup tables."""

from .index import DiseaseCuration, DiseaseIndex, DrugIndex, TargetIndex

__all__ = ["DiseaseCuration", "DiseaseIndex", "DrugIndex", "TargetIndex"]
