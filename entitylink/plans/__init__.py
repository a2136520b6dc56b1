"""Schemas of the lookup tables and their comparison."""

from .schema import NORMALISED, RAW, READY, LookupTable, NormalisedLUT, RawLUT, ReadyLUT, SchemaValidationError, compare_schemas, validated

__all__ = ["NORMALISED", "RAW", "READY", "LookupTable", "NormalisedLUT", "RawLUT", "ReadyLUT", "SchemaValidationError", "compare_schemas", "validated"]
