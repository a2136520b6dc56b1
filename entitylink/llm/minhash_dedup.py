"""Near-duplicate documents by MinHash with tensored banding.

A text's set are its distinct word shingles.  Two small collections of bands are computed, one
with bands of two minhashes and one of three; a table key is a pair of one band from each.  With
10 and 15 bands there are 150 tables for 65 minhashes, where bands of their own would take 750.
Two sets of similarity s meet in some table with probability
(1 - (1 - s^2)^10) (1 - (1 - s^3)^15): at 0.8 all but 6 in 100,000 do.

1. Texts with the same set are one node.  (A task signs each set once; copies add no table rows.)
2. Rows (key, node) meet by key; keys with one node go.  Every node is tied to the smallest node
   of each of its buckets (or of its cell of a large bucket): stars, not pairs.
3. A node's smallest candidate is confirmed on full sets, then the rest of its stars.  What is
   linked already is left out each time.
4. Nodes of buckets that still hold several components are joined exactly, by prefixes of their
   sets, across components: no pair that meets in a table is left out.
5. Components are taken by large-star and small-star rounds.

No task gets all rows of a hot bucket, star or component: large buckets are dealt to cells, what
belongs to the centre of a star is broadcast or copied.  Sets are told by 64-bit hashes of their
shingles; links between different sets are confirmed on the shingles themselves.

Cases: very long texts are taken whole.  Null and empty texts, and white space alone, have an empty set and are linked with nothing.
Rows that share a doc_id are one document.  Rows with a null doc_id are linked with nothing and
kept (component_id is null).  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles
from .common import BROADCAST_ROWS, bounded, hot_from, hot_keys, join_one, materialize, parts_for, read, remove, scratch, ship, without
from .components import components, merge_labels
from .tokens import chunks

#: (bands, minhashes in a band) of the two collections.
COLLECTIONS = ((10, 2), (15, 3))
SIGNED = "doc_id long, rep long, n_shingles long, set_digest binary, u array<long>, v array<long>, sketch array<long>"
#: Bits of a set's sketch; each shingle turns one of them over.
SKETCH = 512


def band_values(flat: np.ndarray, each: np.ndarray, collections=COLLECTIONS) -> list[np.ndarray]:
    """For each collection, a row of band hashes for each set that isn't empty."""
    starts = (np.cumsum(each) - each)[each > 0]
    out = []
    for number, (bands, rows) in enumerate(collections):
        values = np.zeros((bands, len(starts)), np.uint64)
        if len(starts):
            step = shingles.constants(rows, 100 + number)
            for k, a in enumerate(shingles.constants(bands * rows, 10 + number)):
                values[k // rows] += np.minimum.reduceat(flat * a, starts) * step[k % rows]
        out.append(shingles.mix(values).T.astype(np.int64))
    return out


def sketches(flat: np.ndarray, each: np.ndarray) -> np.ndarray:
    """SKETCH bits, as longs, for each set that isn't empty.  Shingles that only one of two sets has
    account for every bit in which their sketches differ, so there are as many of them at least."""
    full = each[each > 0]
    of = np.repeat(np.arange(len(full)), full)
    odd = np.bincount(of * SKETCH + (flat >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH * len(full)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1).view(np.int64)


def may_link(percent: int, x: str, y: str) -> str:
    """False for sets (n, sketch) that sizes and sketches show to be too different; exact."""
    apart = " + ".join(f"bit_count({x}.sketch[{k}] ^ {y}.sketch[{k}])" for k in range(SKETCH // 64))
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
        f" and {100 + percent} * ({x}.n + {y}.n - ({apart})) >= {2 * percent} * ({x}.n + {y}.n)"
    )


def sign(docs: DataFrame, width: int, collections) -> DataFrame:
    """SIGNED for each row with a doc_id; only the first row with a set in a task has u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for batch, texts in chunks(batches, most=1 << 20):
            flat, each = shingles.shingle_sets(texts, width)
            u, v = (iter(x) for x in band_values(flat, each, collections))
            drawn = iter(sketches(flat, each))
            ids = batch.column("doc_id").to_pylist()
            rows, end = [], 0
            for doc_id, n in zip(ids, each.tolist(), strict=True):
                end += n
                if not n:
                    rows.append((doc_id, doc_id, 0, None, None, None, None))
                    continue
                digest = hashlib.blake2b(flat[end - n : end].tobytes(), digest_size=16).digest()
                rep, own = first.setdefault(digest, doc_id), (next(u), next(v), next(drawn))
                new = rep == doc_id
                rows.append((doc_id, rep, n, digest, *(own if new else (None, None, None))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "rep", "n_shingles", "set_digest", "u", "v", "sketch"])

    ship(docs.sparkSession)
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def table_rows(nodes: DataFrame) -> DataFrame:
    """key, node: a row for each pair of a band of u and one of v."""
    return (
        nodes.select("node", F.posexplode("u").alias("_i", "_u"), "v")
        .select("node", "_i", "_u", F.posexplode("v").alias("_j", "_v"))
        .select(F.xxhash64("_i", "_j", "_u", "_v").alias("key"), "node")
    )


#: Pairs of texts that a task compares at least.
TASK_PAIRS = 1_000


#: Nodes of a bucket from which on it is dealt to cells, if they are a thousandth of all, too.
CELL_NODES = 20_000
#: One node in so many is looked at to find the buckets that are so large.
LOOKED_AT = 64


def bucket_stars(first: DataFrame, count: int) -> DataFrame:
    """key, node, low: the nodes of buckets with several, and the smallest node beside each.

    A bucket that may hold a large share of all nodes is dealt to cells (some thousand buckets are,
    at most).  Its nodes are tied to the smallest one of their cell, and that one to the smallest
    of all.  Which buckets are so large is told from one node in LOOKED_AT; a wrong guess costs
    time only."""
    rows = table_rows(first)
    seen = first.filter(F.pmod(F.xxhash64("node", F.lit("look")), F.lit(LOOKED_AT)) == 0)
    (found,) = table_rows(seen).agg(F.expr("approx_top_k(key, 4096, 65536)")).head()
    each = max(CELL_NODES, count // 1000)
    large = {x["item"]: x["count"] * LOOKED_AT for x in found if x["count"] * LOOKED_AT > each and x["count"] > 8}
    if large:
        # as many cells in all of them, so that nodes which share many large buckets share a cell in each
        cell = F.pmod(F.xxhash64("node"), F.lit(-(-max(large.values()) // each)))
        dealt = F.broadcast(first.sparkSession.createDataFrame([(k, True) for k in large], "key long, _dealt boolean"))
        rows = rows.join(dealt, "key", "left").withColumn("_cell", F.when(F.col("_dealt"), cell)).drop("_dealt")
    cell = Window.partitionBy("key", *["_cell"] * bool(large))
    rows = rows.withColumn("low", F.min("node").over(cell)).withColumn("_high", F.max("node").over(cell))
    rows = materialize(rows.filter("low < _high or _cell is not null" if large else "low < _high").drop("_high"))
    if not large:
        return rows
    lows = F.broadcast(rows.filter("_cell is not null").groupBy("key").agg(F.min("node").alias("_least")))
    lowest = F.when(F.col("node") == F.col("low"), F.coalesce("_least", "low")).otherwise(F.col("low"))
    return materialize(rows.join(lows, "key", "left").select("key", "node", lowest.alias("low")))


def confirmed(pairs: DataFrame, nodes: DataFrame, n_nodes: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b; materialized) with 100 * intersection >= percent * union of their full sets.

    Sizes and sketches, a few bytes a node, rule out most others before texts are brought together.
    The text of a b that many pairs share is copied, once for every few pairs, so that no task gets
    all texts beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, frozenset()
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for n, (one, two) in enumerate(zip(batch.column("_ta"), batch.column("_tb"), strict=True)):
                two = two.as_py()
                if two != last:
                    last, right = two, shingles.plain_set(two, width)
                left = shingles.plain_set(one.as_py(), width)
                both = len(left & right)
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(n)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    count, hot = hot_keys(pairs, "b")
    few, more = parts_for(pairs, max(count, n_nodes)), parts_for(pairs, max(count, n_nodes), TASK_PAIRS)
    x, y = nodes.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x")), nodes.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y"))
    like = join_one(pairs, y, "b", hot).coalesce(few).join(x, "a").coalesce(few).filter(may_link(percent, "x", "y")).select("a", "b")
    left = texts.select(F.col("node").alias("a"), F.col("body").alias("_ta"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("_tb"))
    beside = ["b"]
    if hot:
        copies = F.broadcast(pairs.sparkSession.createDataFrame([(b, -(-n // hot_from(count))) for b, n in hot.items()], "b long, _copies int"))
        again = right.join(copies, "b").select("b", "_tb", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_copies") - 1))).alias("_copy"))
        right = right.withColumn("_copy", F.lit(0)).unionByName(again)
        like = like.join(copies, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("_copies", F.lit(1))).cast("int").alias("_copy"))
        beside.append("_copy")
    met = like.join(left, "a").coalesce(more).join(right, beside).select("a", "b", "_ta", "_tb")
    return materialize(met.mapInArrow(run, "a long, b long").coalesce(more).distinct().coalesce(few))


def between(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) in different components among the nodes of buckets that hold several.

    Not all pairs of a bucket: two sets that are similar enough share one of their first
    shingles in a common order, rare ones first (Xiao et al., 2008).  Shingles that one component
    has alone come before all others, as they join no two components.  Each set's prefix is as long
    as its size demands, and a meeting counts only if what is left behind it on both sides can
    still reach the overlap that the two sizes demand, and if sketches allow it.  Nodes of the
    component that has a shingle most often are not laid beside each other, so a large group of
    copies meets what is not of it, and not itself.
    """
    spans = buckets.join(labels, "node").groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    keys = materialize(spans.filter("_lo < _hi").select("key"))
    count = keys.count()
    within = buckets.join(F.broadcast(keys), "key") if count <= BROADCAST_ROWS else join_one(buckets, keys, "key", hot_keys(buckets, "key")[1])
    mixed = within.select("node").distinct().join(labels, "node")

    passed = ["node", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in chunks(batches, "body", 1 << 20):
            flat, each = shingles.shingle_sets(bodies, width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(each), lists], names=[*passed, "n", "_set"])

    sets = texts.join(mixed, "node").select(*passed, "body").mapInArrow(run, "node long, component long, n long, _set array<long>")
    rows = sets.select(*passed, "n", F.explode("_set").alias("shingle"))
    by_component = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("_n"))
    shared = (
        by_component.groupBy("shingle")
        .agg(F.sum("_n").alias("df"), F.max(F.struct("_n", "component"))["component"].alias("most"), F.count(F.lit(1)).alias("_in"))
        .filter("_in > 1").drop("_in")
    )
    own = Window.partitionBy("node", "n")
    placed = (
        rows.join(shared, "shingle")
        .withColumn("_alone", F.col("n") - F.count(F.lit(1)).over(own))  # its shingles that no other component has come first
        .withColumn("at", F.col("_alone") + F.row_number().over(own.orderBy("df", "shingle")))
        .filter(f"at <= n - ceil(n * {percent} / 100.0) + 1")
        .join(nodes, ["node", "n"])  # rows are where the window had them
        .select("shingle", *passed, "most", "n", "at", "sketch")
    )
    placed = materialize(placed)  # read twice
    one, two = placed.filter("component <> most").alias("x"), placed.alias("y")
    met = one.join(two, "shingle").filter(
        "x.component <> y.component and (y.component = y.most or x.node > y.node)"
        f" and {may_link(percent, 'x', 'y')}"
        f" and {100 + percent} * (1 + least(x.n - x.at, y.n - y.at)) >= {percent} * (x.n + y.n)"
    )
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b and their components, for pairs that are in different ones."""
    pairs = materialize(pairs)
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    return materialize(join_one(pairs, b, "b", hot_keys(pairs, "b")[1]).join(a, "a").filter("_ca <> _cb"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, collections=COLLECTIONS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, width, collections))
    reps = signed.filter("u is not null").withColumn("node", F.min("rep").over(Window.partitionBy("set_digest")))
    first = reps.filter("rep = node")
    nodes = materialize(first.select("node", F.col("n_shingles").alias("n"), "sketch"))
    n_nodes = nodes.count()
    buckets = bucket_stars(first, n_nodes)
    rows = buckets.count()
    buckets = buckets.coalesce(parts_for(buckets, rows))
    labels = materialize(buckets.select("node").distinct().withColumn("component", F.col("node")))
    folder, count = None, labels.count()
    labels = labels.coalesce(parts_for(labels, count))
    if count:
        folder = scratch(spark, "near")
        wanted = bounded(labels.select(F.col("node").alias("_node")))
        docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("body")).join(wanted, F.col("node") == F.col("_node")).drop("_node").distinct().coalesce(parts_for(labels, count, TASK_PAIRS)).write.parquet(folder)
        texts = spark.read.parquet(folder)
        stars = buckets.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        nearest = materialize(stars.groupBy("a").agg(F.min("b").alias("b")).coalesce(parts_for(labels, count)))
        labels = merge_labels(labels, confirmed(nearest, nodes, n_nodes, texts, width, percent))
        for pairs in (lambda: stars.distinct(), lambda: between(buckets, labels, nodes, texts, width, percent)):
            left = apart(pairs(), labels)
            links = confirmed(left.select("a", "b"), nodes, n_nodes, texts, width, percent)
            joined = links.join(left, ["a", "b"]).select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))
            labels = merge_labels(labels, joined)
    # back to all documents: set -> node -> component -> its smallest doc_id
    of_rep = reps.select("rep", "node").distinct()
    low = signed.groupBy("rep").agg(F.min("doc_id").alias("_low"))
    of_rep = materialize(of_rep.join(low, "rep").join(labels, "node", "left").select("rep", "_low", F.coalesce("component", "node").alias("component")))
    least = materialize(of_rep.groupBy("component").agg(F.min("_low").alias("component_id")))
    of_rep = materialize(join_one(of_rep, least, "component", hot_keys(of_rep, "component")[1]).select("rep", "component_id"))
    of_rep = of_rep.groupBy("rep").agg(F.min("component_id").alias("component_id"))
    if folder:
        remove(spark, folder)
    ids = signed.select("doc_id", "rep", "n_shingles").join(of_rep, "rep", "left")
    ids = ids.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    done = ids.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = _nameless(docs, width)
    return done if nameless is None else done.unionByName(nameless)


def _nameless(docs: DataFrame, width: int) -> DataFrame | None:
    """The rows without a doc_id, of which nothing can be said but their number of shingles."""
    rest = docs.filter("doc_id is null")
    if not rest.select("doc_id").take(1):
        return None
    counted = sign(rest.select(F.lit(0).alias("doc_id"), "text"), width, COLLECTIONS)
    return counted.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, the one with the smallest doc_id; columns as they were,
    whatever their names.  Rows without a doc_id stay.  Where ids repeat, rows are numbered in the
    order of their ids first (and written once), and every row counts for itself."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    if not ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").take(1):
        rows = docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("_of"))
    else:
        named = docs.filter("doc_id is not null")
        own = named.select(named["doc_id"].alias("_id"), named["text"], F.struct(*[named[c] for c in docs.columns]).alias("_of"))
        ordered = own.repartitionByRange("_id", F.xxhash64("text")).sortWithinPartitions("_id", F.xxhash64("text"))
        rows = materialize(ordered.select(F.monotonically_increasing_id().alias("doc_id"), "text", "_of"))
        bare = docs.filter("doc_id is null")
        rows = rows.unionByName(bare.select(F.lit(None).cast("long").alias("doc_id"), "text", F.struct(*[bare[c] for c in docs.columns]).alias("_of")))
    gone = near_groups(rows.select("doc_id", "text"), **options).filter("not kept").select("doc_id").distinct()
    return without(rows.select("doc_id", "_of"), materialize(gone)).select("_of.*")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), width=2, percent=80)
