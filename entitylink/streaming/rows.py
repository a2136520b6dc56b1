"""Labels of a stream, or of a table whose repeated rows must stay, against a static lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise, text
from ..operators.mapper import EntityMapper
from ..sources.index import DISEASE, DRUG, LABEL


def map_labels(mapper: EntityMapper, df: DataFrame, result_col_name: str, entity_col_name: str, entity_type: str) -> DataFrame:
    """df with the ids of each label, as map_entities() gives them.

    Both spellings are joined on their own, so no row waits for another: there is no state, and
    output can be appended.
    """
    lut = mapper.df.filter((F.col("entityKind") == LABEL) & (F.col("entityType") == entity_type))
    label = F.col(entity_col_name)
    track = F.lit(text.SYMBOL) if entity_type == DRUG else text.determine_track(label)
    spelled = text.alternatives(F.trim(label))
    out = df
    for n in (0, 1):
        form = F.get(spelled, n)
        form = text.clean_prefix(form) if entity_type == DISEASE else form
        found = lut.select(F.col("entityLabelNormalised").alias(f"__el_{n}"), F.col("entityIds.entityId").alias(f"__el_ids{n}"))
        out = out.withColumn(f"__el_{n}", normalise.normalised(form, track)).join(found, f"__el_{n}", "left")
    none = F.array().cast("array<string>")
    ids = F.array_union(F.coalesce("__el_ids0", none), F.coalesce("__el_ids1", none))
    return out.withColumn("__el_all", ids).select(*df.columns, F.when(F.size("__el_all") > 0, F.col("__el_all")).alias(result_col_name))
