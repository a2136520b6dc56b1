"""Cross-entropy difference of two n-gram models over one vocabulary (Moore and Lewis, 2010).

The target model counts the documents labelled as good and not toxic, the background model all
documents; both count the same words and pairs of words, whole texts, without a sample.  A word or
pair is told by 63 bits of hash and one that tells which it is, not by an entry of a table of fixed
size, so the tables grow with the corpus.  They stay with the executors: documents are dealt to chunks by a hash; each
chunk sends its distinct keys with their counts, dealt to buckets by key; a bucket adds up what all
chunks sent and answers each with totals in the order of its keys; and a chunk, which finds the
same keys in the same order, scores its documents with them.  A key comes to its bucket once from
a chunk at most, however common it is.

The loss of a token w after v is -ln((1 - mix) * c(v, w) / c(v) + mix * (c(w) + 1) / (n + entries));
the pair's part is left out for a text's first word, and where v has no count.  `entries` is the
number of distinct words of all documents, or `least_entries` if there are fewer.  A document's own
counts are taken from the models that counted it first, as else every document of the target would
look like the target.  A document's score is the mean over its tokens of target loss less
background loss: lower is more like the target.

Cases: null and empty texts, and texts without words, have no tokens and null scores.  Labels that
differ count as good only if all are.  Rows that share a doc_id share labels and are counted and
scored each.  Without target documents the target model is uniform.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import bounded, materialize, read, ship
from .tokens import chunks, release

#: The vocabulary is smoothed as one of 2**WORD_BITS words at least.
WORD_BITS = 17
#: Text of a chunk, and text whose keys share a bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20


def grams(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of all texts in a row: keys of words (even), keys of pairs (odd; none for a
    text's first word), and which tokens are a first word; then how many tokens each text has, and
    which texts are of the target."""
    parts, good = [(np.empty(0, np.uint64), np.empty(0, np.int64))], []
    for batch, texts in chunks(batches, most=1 << 20):
        parts.append(shingles.words(texts))
        good += [bool(x) for x in batch.column("_target").to_pylist()]
    word, each = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.zeros(len(word), bool)
    first[(np.cumsum(each) - each)[each > 0]] = True
    later = np.flatnonzero(~first)
    pair = shingles.mix(word[later - 1] * np.uint64(0x9E3779B97F4A7C15) + word[later])
    return word & ~np.uint64(1), pair | np.uint64(1), first, each, np.array(good, bool)


def target_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("_good")).filter("_good = 1").select("doc_id")


def _marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text (binary), _target (true or null)."""
    ids = target.withColumn("_target", F.lit(True))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(bounded(ids), "doc_id", "left")


def start_of(bucket: int, buckets: int) -> np.uint64:
    """The smallest key of a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def pack_keys(keys: np.ndarray, start: np.uint64) -> bytes:
    """Steps between ascending keys, in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=start)
    width = -(-int(steps.max(initial=0)).bit_length() // 8)
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes, n: int, start: np.uint64) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if n:
        width = len(data) // n
        steps[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + start


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more follow in full."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], "<i8")
    return counts


SENT = "bucket int, chunk int, n int, keys binary, background binary, target binary"
TOTALS = "chunk int, bucket int, n int, background binary, target binary, words long, tokens long, good long"


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def send(dealt: DataFrame, buckets: int) -> DataFrame:
    """The distinct keys of each chunk in ascending order, and their counts in the chunk: a row for
    each bucket, also for one without keys, as the answer tells the size of the models."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        word, pair, first, each, good = grams(part.to_batches())
        good = np.repeat(good, each)
        keys, back, n = np.unique(np.concatenate((word, pair)), return_inverse=True, return_counts=True)
        target = np.bincount(back[np.concatenate((good, good[~first]))], minlength=len(keys))
        starts = [start_of(k, buckets) for k in range(buckets)]
        cut = [*np.searchsorted(keys, np.array(starts, np.uint64)).tolist(), len(keys)]
        rows = [(k, key[0].as_py(), b - a, pack_keys(keys[a:b], starts[k]), pack_counts(n[a:b]), pack_counts(target[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
        word = pair = first = good = keys = back = n = target = None
        release()
        return table(rows, SENT)

    return dealt.groupBy("chunk").applyInArrow(run, SENT)


def add_up(sent: DataFrame, buckets: int) -> DataFrame:
    """For each row sent, the counts of its keys in all documents; and how many distinct words,
    tokens and tokens of the target the bucket has."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        start, each = start_of(key[0].as_py(), buckets), part.column("n").to_pylist()
        keys, back = np.unique(np.concatenate([unpack_keys(k, n, start) for k, n in zip(part.column("keys").to_pylist(), each, strict=True)]), return_inverse=True)
        word = keys & np.uint64(1) == 0
        cut, totals, sizes = np.cumsum(each)[:-1], [], []
        for name in ("background", "target"):
            counts = np.concatenate([unpack_counts(c, n) for c, n in zip(part.column(name).to_pylist(), each, strict=True)])
            sums = np.bincount(back, counts, len(keys)).astype(np.int64)
            sizes.append(int(sums[word].sum()))
            totals.append([pack_counts(own) for own in np.split(sums[back], cut)])
        rows = [(c, key[0].as_py(), n, b, t, int(word.sum()), *sizes) for c, n, b, t in zip(part.column("chunk").to_pylist(), each, *totals, strict=True)]
        keys = back = word = counts = sums = None
        release()
        return table(rows, TOTALS)

    return sent.groupBy("bucket").applyInArrow(run, TOTALS)


def own_counts(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each token, how often its key stands in its own document."""
    _, back, n = np.unique(of * (1 << 32) + key, return_inverse=True, return_counts=True)
    return n[back]


def losses(counts: tuple[np.ndarray, np.ndarray, int], first: np.ndarray, own: tuple[np.ndarray, ...], out: np.ndarray, entries: int, mix: float) -> np.ndarray:
    """Loss of each token under a model.

    counts: of each token's word, of its pair (0 for first words), and of all tokens.
    own: for each token the document's own counts of the same.
    out: which tokens the model has counted.
    """
    alone_n = counts[0] - out * own[0]
    alone = (alone_n + 1) / (counts[2] - out * own[2] + entries)
    before = np.concatenate(([0], alone_n[:-1]))[: len(first)]
    seen = np.where(first, 0, before)
    after = (counts[1] - out * own[1]) / np.maximum(1, seen)
    return -np.log(np.where(seen > 0, (1 - mix) * after + mix * alone, alone))


SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double"


def score_documents(docs: DataFrame, labels: DataFrame, least_entries: int = 1 << WORD_BITS, mix: float = 0.3, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, loss_difference for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = _marked(docs, materialize(target_ids(labels)))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_chunks, n_buckets = 1 + size // chunk_bytes, 1 + size // bucket_bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks_for = lambda n: min(n, max(tasks, n // 4))
    # both uses of the chunks share one shuffle
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")).repartition(tasks_for(n_chunks), "chunk")
    totals = add_up(send(dealt, n_buckets).repartition(tasks_for(n_buckets), "bucket"), n_buckets).repartition(tasks_for(n_chunks), "chunk")

    def run(key: tuple, answer: pa.Table, part: pa.Table) -> pa.Table:
        word, pair, first, each, good = grams(part.to_batches())
        of = np.repeat(np.arange(len(each)), each)
        _, back = np.unique(np.concatenate((word, pair)), return_inverse=True)
        w, p = back[: len(word)], back[len(word) :]
        own_pair, both = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        own_pair[~first] = own_counts(p, of[~first])
        own = (own_counts(w, of), own_pair, each[of])
        order = np.argsort(answer.column("bucket").to_numpy()).tolist()
        sizes = answer.column("n").to_pylist()
        words, tokens, good_tokens = (sum(answer.column(k).to_pylist()) for k in ("words", "tokens", "good"))
        entries = max(least_entries, words)
        ends, means = np.cumsum(each), []
        for name, n, out in (("target", good_tokens, good[of]), ("background", tokens, np.ones(len(of), bool))):
            sent = answer.column(name).to_pylist()
            counts = np.concatenate([np.empty(0, np.int64), *(unpack_counts(sent[k], sizes[k]) for k in order)])
            both[~first] = counts[p]
            total = np.concatenate(([0], np.cumsum(losses((counts[w], both, n), first, own, out, entries, mix))))
            means.append((total[ends] - total[ends - each]) / np.maximum(1, each))
        means.append(means[0] - means[1])
        ids = part.column("doc_id")
        of = back = w = p = own = own_pair = both = counts = total = None
        release()
        return pa.table([ids, pa.array(each), *(pa.array(m, mask=each == 0) for m in means)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    return totals.groupBy("chunk").cogroup(dealt.groupBy("chunk")).applyInArrow(run, SCORED)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
