"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing looks only at lengths, of which there are at most `capacity`: the counts of
pieces by length are all that the driver needs, whatever the number of documents.  The planner
takes lengths from the longest down and puts all pieces of a length at once, exactly where
best-fit decreasing would put them one by one: a segment tree over remaining capacities finds the
tightest open bins in logarithmic time; a tightest bin takes pieces of that length until none
fits.  The plan is a list of runs (pieces by rank within their length, bins by number).  Pieces
get their rank from counts by (length, block), and their bin from their run; all this is done in
parallel over rows of a few numbers.

Cases: a null or empty text is the end id alone (one piece of length 1).  Repeated rows are
packed each.  Null ids are carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block, blocks_of, materialize, number_within, read, ship
from .tokens import WordEncoder, chunks, default_tokenizer, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Which remaining capacities (0 to `most`) have open bins."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, full: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = full
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        at = self.leaves + least
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, pieces in a bin, first bin, offset) and the number of bins."""
    tree, open_bins, runs, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def give(first: int, n: int, left: int) -> None:
        if n and left:
            open_bins[left].append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens in sequences of {capacity}")
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-rest // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].pop()
                tree.set(left, bool(open_bins[left]))
            fit = left // length
            filled = min(n, rest // fit)
            if filled:
                take = filled * fit
            else:
                filled, take, fit = 1, rest, rest
            runs.append((length, rank, take, fit, first, capacity - left))
            give(first, filled, left - fit * length)
            give(first + filled, n - filled, left)
            rank, rest = rank + take, rest - take
    return np.array(runs, np.int64).reshape(-1, 6), bins


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch, texts in chunks(batches, words=True):
            ids, each = with_end(*encoder.encode(texts), end_id)
            number = -(-each // capacity)
            of = np.repeat(np.arange(len(each)), number)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, each[of] - start)
            at, data = (np.cumsum(each) - each)[of] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id)
    pieces = materialize(pieces.withColumn("_block", block(["doc_id", "piece", "ids_crc32"], blocks_of(spark))))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs, _ = plan(counts, capacity)
    plan_of = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    ranked = number_within(pieces, ["length"], "_block", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, fit, bins, offset = plan_of.value.T
        # (length, rank) in one number that floats don't touch
        keys = (length << 48) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (own << 48) + rank, "right") - 1
            inside = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins[at] + inside // fit[at]), pa.array(offset[at] + inside % fit[at] * own)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.drop("_block").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def packed_ids(docs: DataFrame, placed: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """sequence_id, ids (array<int>): the sequences themselves, from documents with unique ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch, texts in chunks(batches, words=True):
            ids, each = with_end(*encoder.encode(texts), end_id)
            ends = np.cumsum(each)
            out = []
            for n, where in enumerate(batch.column("_at").to_pylist()):
                a = ends[n] - each[n]
                out += [(w["sequence_id"], w["offset"], ids[a + w["start"] : a + w["start"] + w["length"]].astype(np.int32)) for w in where]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    where = placed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("_at"))
    parts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(where, "doc_id").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    # a sequence has `capacity` ids at most
    return parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
