"""Lookup-table schemas, checked against the analysed plan (no data is read)."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=False)


_TEXT = T.StringType()
RAW = T.StructType(
    [
        _required("entityId", _TEXT),
        _required("entityLabel", _TEXT),
        _required("entityScore", T.DoubleType()),
        _required("nlpPipelineTrack", _TEXT),
        _required("entitySource", _TEXT),
        _required("entityType", _TEXT),
        _required("entityKind", _TEXT),
    ]
)
NORMALISED = T.StructType([*RAW.fields, _required("entityLabelNormalised", _TEXT)])
READY = T.StructType(
    [
        _required("entityKind", _TEXT),
        _required("entityType", _TEXT),
        _required("entityLabelNormalised", _TEXT),
        _required("entityIds", T.ArrayType(T.StructType([_required("entityId", _TEXT), _required("entitySource", _TEXT)]), containsNull=False)),
    ]
)


class SchemaValidationError(Exception):
    """Carries what was said in `message` and the issues by kind in `errors`."""

    def __init__(self, message: str, errors: dict[str, list[str]]) -> None:
        self.message, self.errors = message, errors
        lines = (f"{kind}: {','.join(names)}" for kind, names in errors.items())
        super().__init__("\n".join([message, *lines]))


def compare_schemas(observed: T.StructType, expected: T.StructType) -> dict[str, list[str]]:
    """Issues by kind: duplicated, missing mandatory and unexpected columns, and types that differ.

    Nested fields are named parent.child, elements of arrays parent[].  Types are compared by
    name, without precision; whether observed columns are nullable is not compared.
    """
    issues: dict[str, list[str]] = defaultdict(list)
    _structs(observed, expected, "", issues)
    return dict(issues)


def _structs(observed: T.StructType, expected: T.StructType, prefix: str, issues: dict) -> None:
    for item, times in Counter(_signature(f) for f in observed.fields).items():
        if times > 1:
            issues["duplicated_columns"].append(prefix + item[0])
    have = {f.name for f in observed.fields}
    issues_missing = [prefix + f.name for f in expected.fields if not f.nullable and f.name not in have]
    if issues_missing:
        issues["missing_mandatory_columns"] += issues_missing
    known = {f.name: f for f in expected.fields}
    for item in observed.fields:
        if item.name in known:
            _types(item.dataType, known[item.name].dataType, prefix + item.name, issues)
        else:
            issues["unexpected_columns"].append(prefix + item.name)


def _signature(item: T.StructField) -> tuple[str, str, bool]:
    return item.name, item.dataType.simpleString(), item.nullable


def _types(observed: T.DataType, expected: T.DataType, name: str, issues: dict) -> None:
    if observed.typeName() != expected.typeName():
        issues["columns_with_non_matching_type"].append(f'For column "{name}" found {observed.typeName()} instead of {expected.typeName()}')
    elif isinstance(observed, T.StructType):
        _structs(observed, expected, f"{name}.", issues)
    elif isinstance(observed, T.ArrayType):
        _types(observed.elementType, expected.elementType, f"{name}[]", issues)


def validated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df itself if it fits the schema."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"a DataFrame is needed, not {type(df).__name__}")
    if not isinstance(schema, T.StructType):
        raise TypeError(f"a StructType is needed, not {type(schema).__name__}")
    if issues := compare_schemas(df.schema, schema):
        raise SchemaValidationError("the DataFrame does not fit the schema", issues)
    return df


class LookupTable:
    """A DataFrame that is known to fit a schema; setting df validates again."""

    SCHEMA: T.StructType

    def __init__(self, df: DataFrame, schema: T.StructType | None = None) -> None:
        self.schema = self.SCHEMA if schema is None else schema
        self.df = df

    @property
    def df(self) -> DataFrame:
        return self._df

    @df.setter
    def df(self, new: DataFrame) -> None:
        self._df = validated(new, self.schema)

    @classmethod
    def get_schema(cls) -> T.StructType:
        return cls.SCHEMA


class RawLUT(LookupTable):
    """A row for each id, spelling, score, track, source, type and kind."""

    SCHEMA = RAW


class NormalisedLUT(LookupTable):
    """A raw table with the normalised label."""

    SCHEMA = NORMALISED


class ReadyLUT(LookupTable):
    """A row for each kind, type and normalised label, with its best ids."""

    SCHEMA = READY
