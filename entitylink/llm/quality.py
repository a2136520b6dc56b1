"""Quality classifier by co-training a content view and a metadata view.

The content view sees the text: shares of characters by kind and of words by hashed bucket, word
lengths, repeated and distinct words.  The metadata view sees source, language and length.  Both
are ridge logistic regressions, first fitted on the driver to a sample of at most `labelled` rows
with a label, those whose hashed ids are smallest, whatever the size of the tables.

In each round every other document, whole, is scored by both views, and each view gives the other
the labels that it is sure of.  What these rows add to the other view's loss is taken as a
quadratic about its present weights: gradients and curvatures are summed on the executors, so all
documents count and only sums of a fixed size reach the driver.  Together they weigh no more than
the rows with a true label.  Each view is then fitted anew to labels and sums, and calibrated on
labelled rows that were kept back.  At last the two are joined as independent evidence: log odds
add up, less the prior's.  All documents are scored, whole texts, in one pass.

Cases: null texts count as empty, very long ones are read whole; null metadata is a value of its
own.  Labels of a document that differ count as the lowest; null labels, and those of documents
that are not there, are no labels.  Of rows with the same doc_id that has a label, the one with the
smallest hash of its text teaches.  Scores that equal the bound are kept.  Without labels of both
kinds all documents score 1 and are kept.  Repeated rows are scored each.  An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import materialize, read, ship
from .tokens import chunks, release

_PUNCTUATION = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_KINDS = {"lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "blank": [0x20, 0x09], "line": [0x0A, 0x0D], "wide": range(0x80, 0x100), "mark": _PUNCTUATION} | {chr(b): [b] for b in _PUNCTUATION}
_KIND_OF = np.zeros((256, len(_KINDS)), np.float32)
for _n, _bytes in enumerate(_KINDS.values()):
    _KIND_OF[list(_bytes), _n] = 1
#: Buckets that words are hashed to.
WORD_BUCKETS = 64
CONTENT = len(_KINDS) + WORD_BUCKETS + 5
BUCKETS = 64
META = 2 * BUCKETS + 24


def content_features(texts: list[bytes | None]) -> np.ndarray:
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    data = np.frombuffer(b"".join([t or b"" for t in texts]), np.uint8)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    counts = np.bincount(of * 256 + data, minlength=256 * len(texts)).reshape(-1, 256)
    out = np.zeros((len(texts), CONTENT), np.float32)
    length = np.maximum(1, sizes)
    out[:, : len(_KINDS)] = np.sqrt(counts @ _KIND_OF / length[:, None])
    hashed, each = shingles.words(texts)
    words, ends = np.maximum(1, each), np.cumsum(each)
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], hashed[1:] == hashed[:-1]))))) if len(hashed) else np.zeros(1)
    starts = ends - each
    inside = np.where(each > 1, same[ends] - same[np.minimum(starts + 1, ends)], 0)
    out[:, -5] = inside / words
    bucket = np.bincount(np.repeat(np.arange(len(texts)), each) * WORD_BUCKETS + (hashed >> np.uint64(58)).astype(np.int64), minlength=WORD_BUCKETS * len(texts))
    out[:, len(_KINDS) : -5] = np.sqrt(bucket.reshape(-1, WORD_BUCKETS) / words[:, None])
    distinct = np.array([len(np.unique(hashed[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    out[:, -4] = distinct / words
    out[:, -3] = np.log1p(distinct) / np.log1p(words)
    out[:, -2] = np.log1p(sizes / words)
    out[:, -1] = np.log1p(each) / 10
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), META), np.float32)
    rows = np.arange(len(lang))
    for k, values in enumerate((lang, source)):
        out[rows, k * BUCKETS + np.array([zlib.crc32(b"" if v is None else b"=" + str(v).encode()) % BUCKETS for v in values], np.int64)] = 1
    out[rows, 2 * BUCKETS + np.array([23 if n is None else min(22, max(0, int(n)).bit_length()) for n in n_chars], np.int64)] = 1
    return out


@dataclass
class View:
    """A ridge logistic regression on standardised features, with a calibration of its log odds."""

    ridge: float = 3.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, more: Sums | None = None) -> View:
        if not len(self.mean):
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.weights = newton(self.design(x), y, self.ridge, more=more)
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What rows add to the loss about the present weights: their number, gradient, curvature."""
        d = self.design(x)
        p = sigmoid(d @ self.weights)
        return np.concatenate(([len(x)], d.T @ (p - y), ((d * (p * (1 - p))[:, None]).T @ d).ravel()))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = newton(np.column_stack((self.raw(x), np.ones(len(x)))), y, 1e-2)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sums:
    """A quadratic about weights `at`, as View.sums() has it, with a weight."""

    at: np.ndarray
    values: np.ndarray
    weight: float

    def slope(self, w: np.ndarray) -> np.ndarray:
        return self.weight * self.values[1 : len(self.at) + 1] + self.bend() @ (w - self.at)

    def bend(self) -> np.ndarray:
        n = len(self.at)
        return self.weight * self.values[n + 1 :].reshape(n, n)


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, more: Sums | None = None) -> np.ndarray:
    x = x.astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        slope = x.T @ (p - y) + penalty * w
        if more is not None:
            hessian, slope = hessian + more.bend(), slope + more.slope(w)
        step = np.linalg.solve(hessian, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    content: View
    meta: View
    prior: float  # log odds

    def score(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: content, metadata, both."""
        a, b = self.content.log_odds(x), self.meta.log_odds(z)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


    def lessons(self, x: np.ndarray, z: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """For each view, the sums of the rows that the other one is sure of."""
        taught = []
        for pupil, own, teacher, seen in ((self.content, x, self.meta, z), (self.meta, z, self.content, x)):
            p = sigmoid(teacher.log_odds(seen))
            rows = (p >= sure) | (p <= 1 - sure)
            taught.append(pupil.sums(own[rows].astype(np.float64), (p[rows] > 0.5).astype(float)))
        return taught[0], taught[1]


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, lessons: Callable[[Model], tuple[np.ndarray, np.ndarray]], rounds: int = 2, back: int = 4) -> Model | None:
    """x, z: the two views of labelled rows; y: 1 or 0; lessons: Model.lessons() summed over all
    other documents.  Every back-th row is kept for calibration.  None if the labels lack a kind."""
    held, own = np.arange(len(y))[::back], np.delete(np.arange(len(y)), np.s_[::back])
    if any(len(np.unique(y[part])) < 2 for part in (held, own)):
        return None
    rate = y[own].mean()
    model = Model(View(), View(), float(np.log(rate / (1 - rate))))
    views, data = (model.content, model.meta), (x, z)
    for k in range(rounds + 1):
        given = lessons(model) if k else (None, None)
        for view, d, sums in zip(views, data, given, strict=True):
            # rows with a true label weigh no less than all others
            more = None if sums is None or not sums[0] else Sums(view.weights, sums, min(1.0, len(own) / sums[0]))
            view.fit(d[own], y[own], more)
        for view, d in zip(views, data, strict=True):
            view.calibrate(d[held], y[held])
    return model


VIEWED = "content array<float>, meta array<float>"


def _features(batch: pa.RecordBatch, texts: list) -> tuple[np.ndarray, np.ndarray]:
    return content_features(texts), meta_features(*(batch.column(c).to_pylist() for c in ("_lang", "_source", "_chars")))


def _inputs(docs: DataFrame) -> list:
    have = set(docs.columns)
    column = lambda name, kind: (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind))
    return [F.col("text").cast("binary").alias("_text"), column("lang", "string").alias("_lang"), column("source", "string").alias("_source"), column("n_chars", "long").alias("_chars")]


def taught(rows: DataFrame, model: Model, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Model.lessons() over all rows: a task sends its sums number by number, Spark adds them up."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch, texts in chunks(batches, "_text", 1 << 20):
            own = shared.value.lessons(*_features(batch, texts), sure)
            total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
        for view, sums in enumerate(total or ()):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(at), pa.array(sums[at])], names=["view", "at", "value"])

    added = rows.select("_text", "_lang", "_source", "_chars").mapInArrow(run, "view int, at long, value double").groupBy("view", "at").agg(F.sum("value").alias("value")).toArrow()
    view_of, at, value = (added.column(c).to_numpy() for c in ("view", "at", "value"))
    out = []
    for view, own in enumerate((model.content, model.meta)):
        n, part = len(own.weights), view_of == view
        sums = np.zeros(1 + n + n * n)
        sums[at[part]] = value[part]
        out.append(sums)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 12_000, rounds: int = 2, sure: float = 0.98) -> Model | None:
    """labelled: rows with a label that are used at most, the one bound there is."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    # the smallest hashes: a sample of a fixed size that is the same in every run; ids alone meet
    marks = marks.join(docs.select("doc_id").filter("doc_id is not null"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = F.broadcast(materialize(marks))  # no more than `labelled` rows
    rows = docs.select("doc_id", *_inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text", 1 << 20):
            x, z = _features(batch, texts)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32())) for v in (x, z)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y").cast(pa.int32()), batch.column("_order"), *arrays], names=["doc_id", "_y", "_order", "content", "meta"])

    own = rows.join(chosen, "doc_id").select(F.col("doc_id").cast("long"), F.col("_y").cast("int"), F.xxhash64("_text", "_lang", "_source", "_chars").alias("_order"), "_text", "_lang", "_source", "_chars")
    seen = own.mapInArrow(run, f"doc_id long, _y int, _order long, {VIEWED}")
    seen = seen.groupBy("doc_id").agg(F.min_by(F.struct("_y", "content", "meta"), "_order").alias("of")).select("doc_id", "of.*").toArrow()
    if not seen.num_rows:
        return None
    ids = seen.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda n: (zlib.crc32(str(ids[n]).encode()), ids[n]))
    x, z = (seen.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order].astype(np.float64) for c in ("content", "meta"))
    y = (seen.column("_y").to_numpy()[order] > 0).astype(float)
    seen = None
    rest = rows.join(chosen.select("doc_id"), "doc_id", "left_anti")
    model = co_train(x, z, y, lambda model: taught(rest, model, sure), rounds)
    x = z = None
    release()  # the driver's memory is bounded, too
    return model


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (a struct of the columns of docs), p_content, p_meta, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text", 1 << 20):
            if shared.value is None:
                scores = [np.ones(batch.num_rows)] * 3
            else:
                scores = shared.value.score(*_features(batch, texts))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, scores)], names=["row", "p_content", "p_meta", "score"])

    schema = kept.select("row").schema.add("p_content", "double").add("p_meta", "double").add("score", "double")
    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """doc_id, p_content, p_meta, score, kept: a row for each row of docs."""
    slim = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])
    scored = score_documents(slim, fit(slim, labels, **options))
    return scored.select("row.doc_id", "p_content", "p_meta", "score", (F.col("score") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs without those that score below `least`; columns as they were."""
    return score_documents(docs, fit(docs, labels, **options)).filter(F.col("score") >= least).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
