"""Mapping of labels and ids, and extraction of names from free text."""

from .mapper import EntityMapper
from .ner import create_ner_pipeline, extract_disease_entities, extract_drug_entities

__all__ = ["EntityMapper", "create_ner_pipeline", "extract_disease_entities", "extract_drug_entities"]
