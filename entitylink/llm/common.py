"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a two-column table of ids may be broadcast (about 32 MB in the JVM).
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session, as in tests, may go without the setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="llm-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Run df once and read it from shared storage from then on (lost executors cost nothing)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage, deleted when the driver ends if it is still there."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def at_end() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            remove(spark, folder)

    atexit.register(at_end)
    return folder


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    package = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(os.fspath(out))


#: Bytes of an Arrow batch, which an executor holds on both sides of each Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for the operators that run Python there, and keep
    batches small: texts may be long, so a number of rows does not bound a batch.  A size of
    batches that the user has set stays; the session keeps the one set here, as plans run later."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _ship(spark)
        _shipped.add(app)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (materialized, narrow rows) with a broadcast hint if its counted size is within the
    limit; beyond it the planner joins by shuffling."""
    return F.broadcast(df) if df.count() <= limit else df


#: A key is hot if more rows than this, and more than a thousandth of all rows, share it.
HOT_ROWS = 256


def hot_keys(rows: DataFrame, *keys: str) -> tuple[int, dict[int, int]]:
    """How many rows there are, and the hot values of the key columns with how many rows hold them
    (about).  One pass with partial sums gives both; there are some thousand at most, however many
    rows there are.  They only tell how to join: a value that is missed costs time."""
    found = rows.agg(F.count(F.lit(1)), *(F.expr(f"approx_top_k({k}, 1000, 16384)") for k in keys)).head()
    totals: dict[int, int] = {}
    for item in (x for top in found[1:] for x in top):
        totals[item["item"]] = totals.get(item["item"], 0) + item["count"]
    least = hot_from(found[0])
    return found[0], {k: n for k, n in totals.items() if n > least}


def hot_from(count: int) -> int:
    """Rows that a key may have before it is hot."""
    return max(HOT_ROWS, count // 1000)


def join_one(rows: DataFrame, one: DataFrame, key: str, hot: dict[int, int], how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has a narrow row for each key at most.  The rows of `one` for hot
    keys, some thousand at most, are broadcast, so that no task gets all rows of such a key."""
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.col(key).isin(list(hot))
    apart = rows.filter(is_hot).join(F.broadcast(one.filter(is_hot)), key, how)
    return apart.unionByName(rows.filter(~is_hot).join(one, key, how))


#: Rows of a few numbers that a task of a small job gets at least.
TASK_ROWS = 20_000


def parts_for(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for a job over `rows` rows: no more than there are partitions, one at least."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // task_rows))


def blocks_of(spark: SparkSession, least: int = 256) -> int:
    """Number of blocks that a group is dealt to before its rows are numbered."""
    return max(least, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def block(hashed: Sequence[Column | str], n: int) -> Column:
    return F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int")


def number_within(df: DataFrame, group: list[str], block_col: str, order: list[Column], out: str) -> DataFrame:
    """Add a gapless number from 0 within each group without bringing the group into one task.

    Rows are numbered within (group, block); the counts of the blocks, one row each, give the
    number at which a block starts.  df must be materialized and group and block_col not null.
    """
    keys = [*group, block_col]
    starts = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_from", F.sum("_n").over(Window.partitionBy(*group).orderBy(block_col)) - F.col("_n"))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    return df.withColumn("_k", inside).join(starts, keys).withColumn(out, F.col("_from") + F.col("_k")).drop("_from", "_k")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is not in ids (materialized, one column of that name)."""
    return docs.join(bounded(ids), key, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  lower() does just that on texts of single-byte characters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
