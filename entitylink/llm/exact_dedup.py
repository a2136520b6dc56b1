"""Exact deduplication by a tree merge of sorted digest runs.

Every document gets a verified digest: SHA-256 of its text with A-Z lower-cased, its length in
bytes and an independent 64-bit hash, all three of which must agree (texts themselves are not
compared: two different ones that agree in all three are not known to exist).  A run holds the
digests of the documents whose ids hash to it; there are as many runs as tasks of a shuffle, in a
power of two.  A run is sorted, and each of its digests keeps one identifier and a count.

The runs then change hands as in a binomial tree.  In a round, the runs whose numbers differ in
one bit only are partners: they swap halves of their digests, told by a bit of the digest, so that
each partner has one half of both runs, sorts it in and keeps, of equal digests, the better
identifier and the sum of counts.  After a round for every bit of the number, each run has its
share of the digests of all documents.  Two bits are taken at once by default, so that the parts
of four runs are merged (`fan_in`).  However common a digest is, no round brings more than
`fan_in` rows of it together, and the work of a round is spread over all runs.  The winners then
go back to the first runs: a digest has as many rows there as there are runs, at most.

The identifier that stays is the largest by default ("max"); "min" keeps the smallest.

Cases: a null text counts as empty; very long texts are digested whole.  Null ids lose against all
others.  Of rows with the same id and text, one is kept.  An empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, materialize, read

DIGEST = ["_sha", "_bytes", "_xx"]


#: Runs at least.
LEAST_RUNS = 64


def number_of_runs(spark: SparkSession, fan_in: int) -> int:
    """A power of fan_in, with a run for each task of a shuffle."""
    runs, wanted = 1, max(LEAST_RUNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while runs < wanted:
        runs *= fan_in
    return runs


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def digests(docs: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("doc_id"), body.alias("_body")).select(
        "doc_id",
        F.unhex(F.sha2("_body", 256)).alias("_sha"),
        F.octet_length("_body").alias("_bytes"),
        F.xxhash64("_body").alias("_xx"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("_run"),
    )


def exchange(merged: DataFrame, bits: int, keep: str) -> DataFrame:
    """A round: the runs that differ only in the bits of this mask swap shares and merge them."""
    share = F.col("_xx").bitwiseAND(F.lit(bits).cast("long")).cast("int")
    better = F.max if keep == "max" else F.min
    return (
        merged.withColumn("_run", F.col("_run").bitwiseAND(~bits).bitwiseOR(share))
        .groupBy("_run", *DIGEST)
        .agg(better("_best").alias("_best"), F.sum("_size").alias("_size"))
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    runs: a power of fan_in, which is a power of two; by default as shuffles have tasks."""
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    runs = runs or number_of_runs(docs.sparkSession, fan_in)
    order = F.desc_nulls_last("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")
    run = Window.partitionBy("_run", *DIGEST)
    rows = materialize(
        digests(docs, key, text, runs)
        .withColumn("_place", F.row_number().over(run.orderBy(order)))
        .withColumn("_size", F.count(F.lit(1)).over(run))
    )
    # what comes first lets null ids lose
    loses = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()
    heads = rows.filter("_place = 1").select("_run", *DIGEST, F.struct(loses.alias("first"), "doc_id", F.col("_run").alias("run")).alias("_best"), "_size")
    merged, done = heads, 1
    while done < runs:
        merged, done = exchange(merged, (fan_in - 1) * done, keep), done * fan_in
    winners = heads.select("_run", *DIGEST).join(merged.drop("_run"), DIGEST)
    return rows.drop("_size").join(winners, ["_run", *DIGEST]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        ((F.col("_best.run") == F.col("_run")) & (F.col("_place") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of equal texts; columns as they were, whatever their names."""
    groups = materialize(exact_groups(docs, **options))
    text = options.get("text", "text")
    rows = docs.select(docs[options.get("key", "doc_id")].alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_of"))
    same = lambda ids: F.col("_id").eqNullSafe(ids["doc_id"])
    # An id may stand both in a kept and in a dropped row: those few rows are settled one by one.
    mixed = materialize(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_any")).filter("_n > 1 and _any").select("doc_id"))
    gone = bounded(materialize(groups.filter("not kept").select("doc_id").distinct()))
    if not mixed.take(1):
        return rows.join(gone, same(gone), "left_anti").select("_of.*")
    mixed = bounded(mixed)
    clear = rows.join(mixed, same(mixed), "left_anti").join(gone, same(gone), "left_anti")
    again = rows.join(mixed, same(mixed), "left_semi").withColumn("_sha", text_digest(F.col("_of")[text]))
    won = groups.filter("kept").select("doc_id", F.col("text_sha256").alias("_won"))
    again = again.join(won, same(won) & (F.col("_sha") == won["_won"]))
    once = again.withColumn("_row", F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_sha"))).filter("_row = 1")
    return clear.select("_of").unionByName(once.select("_of")).select("_of.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))
