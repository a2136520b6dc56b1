import pytest
from pyspark.sql import types as T

from entitylink.plans import RAW, READY, RawLUT, ReadyLUT, SchemaValidationError, compare_schemas, validated


def frame(spark, schema):
    return spark.createDataFrame([], schema)


def test_fitting(spark):
    assert compare_schemas(RAW, RAW) == {} and compare_schemas(READY, READY) == {}
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW])
    assert RawLUT(frame(spark, loose)).df.columns == RAW.names


def test_issues():
    seen = T.StructType([RAW["entityId"], RAW["entityId"], T.StructField("entityScore", T.StringType()), T.StructField("other", T.LongType())])
    assert compare_schemas(seen, RAW) == {
        "duplicated_columns": ["entityId"],
        "missing_mandatory_columns": ["entityLabel", "nlpPipelineTrack", "entitySource", "entityType", "entityKind"],
        "columns_with_non_matching_type": ['For column "entityScore" found string instead of double'],
        "unexpected_columns": ["other"],
    }


def test_nested_issues():
    inner = T.StructType([T.StructField("entityId", T.LongType()), T.StructField("more", T.StringType())])
    seen = T.StructType([*READY.fields[:3], T.StructField("entityIds", T.ArrayType(inner))])
    assert compare_schemas(seen, READY) == {
        "missing_mandatory_columns": ["entityIds[].entitySource"],
        "columns_with_non_matching_type": ['For column "entityIds[].entityId" found long instead of string'],
        "unexpected_columns": ["entityIds[].more"],
    }


def test_errors(spark):
    with pytest.raises(SchemaValidationError) as raised:
        ReadyLUT(frame(spark, RAW))
    assert "missing_mandatory_columns: entityLabelNormalised,entityIds" in str(raised.value)
    assert raised.value.message == "the DataFrame does not fit the schema"
    assert raised.value.errors["unexpected_columns"] == ["entityId", "entityLabel", "entityScore", "nlpPipelineTrack", "entitySource"]
    with pytest.raises(TypeError):
        RawLUT("no frame")
    with pytest.raises(TypeError):
        validated(frame(spark, RAW), "no schema")
    table = RawLUT(frame(spark, RAW))
    with pytest.raises(SchemaValidationError):
        table.df = frame(spark, READY)
    other = T.StructType([T.StructField("x", T.LongType())])
    assert RawLUT(frame(spark, other), other).schema == other
