"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run()
writes every stage's result as Parquet to the shared folder and reads it again for the next, so a
lost executor costs no more than the stage at hand.  All but the last return the columns of docs.

Nulls: a null text counts as empty.  Rows without a doc_id are judged by the classifier, for exact
copies (of which one row stays) and for benchmark passages; near copies among them stay.  Every row
is judged by itself, also where ids repeat.  Very long texts are taken whole.  Empty tables and
further columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entitylink.llm.common import read, remove, scratch
from entitylink.llm.decontamination import drop_contaminated
from entitylink.llm.exact_dedup import drop_copies
from entitylink.llm.minhash_dedup import drop_near_copies
from entitylink.llm.packing import pack_documents
from entitylink.llm.quality import keep_good

SEQUENCE = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays, the one with the largest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of SEQUENCE tokens."""
    return pack_documents(docs, capacity=SEQUENCE)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: The classifier and the packing plan are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)  # nothing reads it any more
        before = folder
    return docs
