"""Token ids to files in Simple-8b, and back.

Format: Parquet as the container (any store that Spark writes to will do, and a lost executor's
files are never seen), one row for each block of whole documents:

    part, block          place in the order of the files, and in the part
    start_in_part        ids in the part before the block
    n_ids                ids of the block
    doc_ids, doc_counts  its documents in order, and their numbers of ids
    offsets              for each frame of 512 ids, the word at which it starts
    words                Simple-8b words, little-endian

Parts are ranges of doc_id in ascending order.  Ids before a document: those of earlier parts (a
sum over one row a part), of earlier blocks of its part, and of earlier documents of its block.

Cases: null or empty texts have the end id alone; a very long one has a block of its own.  Null doc_ids come first.  Rows with the same
doc_id stand in the order of a hash of their text.  An empty table gives no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import bounded, materialize, read, scratch, ship
from .tokens import WordEncoder, chunks, default_tokenizer, with_end

BLOCKS = "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, doc_counts array<long>, offsets array<long>, words binary"
#: Ids at which a block is closed.
BLOCK_IDS = 1 << 16
#: Words that a worker keeps.
TABLE_WORDS = 600_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Encode whole texts and write the files of the format in ascending doc_id order."""
    name = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, before = WordEncoder.of(name, TABLE_WORDS), TaskContext.get().partitionId(), 0, 0
        for batch, texts in chunks(batches, words=True):
            ids, each = with_end(*encoder.encode(texts), end_id)
            doc_ids = batch.column("doc_id")
            ends = np.cumsum(each)
            cut = np.flatnonzero(np.diff(ends // BLOCK_IDS)) + 1
            rows = []
            for a, b in zip([0, *cut], [*cut, len(each)], strict=True):
                low = int(ends[a] - each[a])
                own = ids[low : ends[b - 1]]
                words, starts = simple8b.encode(own)
                rows.append((part, block, before, len(own), doc_ids.slice(a, b - a).to_pylist(), each[a:b], starts, words.astype("<u8").tobytes()))
                block, before = block + 1, before + len(own)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "block", "start_in_part", "n_ids", "doc_ids", "doc_counts", "offsets", "words"])

    ship(docs.sparkSession)
    (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .mapInArrow(run, BLOCKS)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, array<long>, if asked for) from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # a row for each part, so no more than the tasks that wrote them: summed in one task, counted
    # and broadcast, so that blocks stay where they are read
    base = bounded(materialize(parts.withColumn("_base", F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).drop("_n")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = simple8b.decode(np.frombuffer(r["words"], "<u8"), np.array(r["offsets"], np.int64), r["n_ids"]).astype("<u4")
                each = np.array(r["doc_counts"], np.int64)
                ends = np.cumsum(each)
                data = memoryview(own).cast("B")
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist(), strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["_base"] + r["start_in_part"] + ends - each), pa.array(each), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(own.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    ship(spark)
    return blocks.join(base, "part").select("part", "start_in_part", "n_ids", "doc_ids", "doc_counts", "offsets", "words", "_base").mapInArrow(run, schema)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-output")
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, ids=False)
