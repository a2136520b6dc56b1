"""Spark-native mapping of free-text labels and ids to canonical ids through lookup tables."""

from .operators import EntityMapper, extract_disease_entities, extract_drug_entities
from .plans import RawLUT, ReadyLUT, SchemaValidationError
from .sources import DiseaseCuration, DiseaseIndex, DrugIndex, TargetIndex

__all__ = ["DiseaseCuration", "DiseaseIndex", "DrugIndex", "EntityMapper", "RawLUT", "ReadyLUT", "SchemaValidationError", "TargetIndex", "extract_disease_entities", "extract_drug_entities"]
