"""Languages of spans and documents: script ranges, word scores and a Viterbi pass.

A word's score for a language is the log likelihood of the byte 4-grams in it (with its edges),
from counts in documents whose language is given.  The scripts of a word, told by ranges of UTF-8
lead bytes, leave only the languages that were seen in them.  The best path through a document's
words, with a penalty for each switch of language, labels spans; the document's language is the
one with the most letters (characters, whatever bytes they take), and its score is that share.

Counts come from the documents with a language, except those held out, of which the `most` rows
with the smallest hashed ids are taken, whatever the size of the table.

Cases: of languages with the same score, and of shares that are equal, the first in alphabetical
order is taken.  Very long texts are labelled whole, as a group of their own.  `und`, score 0, for
null texts and texts without a letter, and for all if nothing could be
learned.  A null doc_id hashes as the empty text.  Repeated rows are labelled each.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship
from .tokens import chunks

UNKNOWN = "und"
BITS = 16
#: Scripts by UTF-8 lead bytes (a range of code points each); 0 tells nothing.
SCRIPTS = {"latin": range(0xC3, 0xCC), "greek": range(0xCE, 0xD0), "cyrillic": range(0xD0, 0xD5), "hebrew": range(0xD6, 0xD8), "arabic": range(0xD8, 0xDC), "indic": range(0xE0, 0xE1), "kana": range(0xE3, 0xE4), "han": range(0xE4, 0xEA), "hangul": range(0xEA, 0xEE)}
#: Which code points of the basic plane are letters.
_ALPHA = np.array([chr(c).isalpha() for c in range(1 << 16)])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[0x61:0x7B] = 1
for _n, _range in enumerate(SCRIPTS.values(), 1):
    _SCRIPT[list(_range)] = _n


def grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of lower-cased texts in a row, each followed by white space: the bucket of the
    4-gram that ends at each byte of a word or just after it, and where words start and end."""
    white = _SPACE[text]
    b0 = np.where(white, 0x20, text).astype(np.uint32)
    b = [b0]
    for k in range(1, 4):
        older = np.full(len(text), 0x20, np.uint32)
        older[k:] = b0[:-k]
        # nothing from before the word; the first k bytes of all have nothing before them
        if k > 1:
            older[b[-1] == 0x20] = 0x20
        b.append(older)
    code = b[0] | b[1] << np.uint32(8) | b[2] << np.uint32(16) | b[3] << np.uint32(24)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], white))))
    return code, edges[::2], edges[1::2]


def lowered(text: bytes) -> bytes:
    """Lower case, with as many code points as before."""
    if text.isascii():
        return text.lower()
    whole = text.decode("utf-8", "replace")
    low = whole.lower()
    return (low if len(low) == len(whole) else "".join(c.lower() if len(c.lower()) == 1 else c for c in whole)).encode()


def letters(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a letter starts there."""
    if not len(data) or data.max() < 0x80:
        return _ALPHA[data]
    first = (data & 0xC0) != 0x80
    out = np.zeros(len(data), bool)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    own = _ALPHA[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    own[beyond] = [chr(p).isalpha() for p in points[beyond].tolist()]
    out[first] = own
    return out


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space after each text, and the ends of the texts."""
    parts = [lowered(t or b"") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    return data, np.cumsum([len(p) + 1 for p in parts])


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # float32, language x bucket
    allowed: np.ndarray  # bool, script x language

    def word_scores(self, texts: list[bytes | None]):
        """scores (word x language), weight and bytes (start, end) of words, and words per text."""
        data, ends = joined(texts)
        code, starts, stops = grams(data)
        each = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64), starts, stops, each
        # from a word's first byte to the white space after it
        cut = np.stack((starts, stops + 1), axis=1).ravel()
        cut = cut[:-1] if cut[-1] >= len(data) else cut
        over = lambda f, v: f.reduceat(v, cut)[::2]
        weight = over(np.add, letters(data).astype(np.int64))
        script = over(np.maximum, _SCRIPT[data])
        out = np.stack([over(np.add, table[code]) for table in self.scores], axis=1)
        out[~self.allowed[script]] -= 1e4
        out[weight == 0] = 0
        return out - out.max(axis=1, keepdims=True), weight, starts, stops, each


def viterbi(scores: np.ndarray, each: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; all texts take a step at a time, longest first."""
    path = np.zeros(len(scores), np.int64)
    order = np.argsort(-each, kind="stable")
    lengths, first = each[order], (np.cumsum(each) - each)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right") if steps else np.zeros(0, int)
    total = np.zeros((len(order), scores.shape[1]))
    final = np.zeros_like(total)
    own = np.arange(scores.shape[1], dtype=np.min_scalar_type(scores.shape[1]))
    back = np.zeros(scores.shape, own.dtype)
    for t in range(steps):
        n = active[t]
        at = first[:n] + t
        now = total[:n]
        if t:
            best = now.argmax(1)
            switched = now[np.arange(n), best][:, None] - penalty
            stay = now >= switched
            back[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, switched)
        now = now + scores[at]
        now -= now.max(1, keepdims=True)
        total[:n] = now
        done = active[t + 1] if t + 1 < steps else 0
        final[done:n] = now[done:]
    state = final.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, most: int = 30_000, smoothing: float = 0.5) -> Model | None:
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter("lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = known.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BITS) + len(SCRIPTS) + 1
        counts: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches, most=1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                data, _ = joined([t for t, own in zip(texts, langs == lang, strict=True) if own])
                code, starts, stops = grams(data)
                if not len(starts):
                    continue
                cut = np.stack((starts, stops), axis=1).ravel()
                lettered = np.add.reduceat(letters(data).astype(np.int64), cut)[::2] > 0
                script = np.maximum.reduceat(_SCRIPT[data], cut)[::2][lettered]
                part = np.repeat(lettered, stops - starts + 1)
                where = np.repeat(starts, stops - starts + 1) + np.arange(len(part)) - np.repeat(np.cumsum(stops - starts + 1) - (stops - starts + 1), stops - starts + 1)
                total = counts.setdefault(lang, np.zeros(size, np.int64))
                total += np.bincount(code[where[part]], minlength=size)
                total += np.bincount(script.astype(np.int64) + (1 << BITS), minlength=size)
        for lang, total in counts.items():
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own), pa.array(total[own])], names=["lang", "bucket", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    languages = sorted(found.lang.unique())
    counts = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS) + 1))
    counts[np.searchsorted(languages, found.lang), found.bucket] = found.n
    words, scripts = counts[:, : 1 << BITS] + smoothing, counts[:, 1 << BITS :]
    scores = np.log(words / words.sum(1, keepdims=True)).astype(np.float32)
    allowed = (scripts >= 0.001 * np.maximum(1, scripts.sum(1, keepdims=True))).T
    allowed[0] = True
    allowed[~allowed.any(1)] = True
    return Model(languages, scores, allowed)


LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: Model | None, penalty: float = 8.0, group_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, lang_pred, score, spans ([start, end) in code points) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in chunks(batches, most=group_bytes):
            rows = []
            if own is not None:
                parts, low, size = [], 0, 0
                for n, t in enumerate(texts):  # scores need more memory for a byte than paths do
                    size += len(t or b"")
                    if size >= 1 << 20 or n == len(texts) - 1:
                        parts.append(own.word_scores(texts[low : n + 1]))
                        low, size = n + 1, 0
                scores, weight, each = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 4))
                path = viterbi(scores, each, penalty)
                starts, stops = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
                end, base, names = 0, 0, own.languages
                at = 0
                for p in parts:
                    for n in p[4].tolist():
                        text, begin = lowered(texts[at] or b""), end
                        end += n
                        rows.append(_document(text, path[begin:end], weight[begin:end], starts[begin:end] - base, stops[begin:end] - base, names))
                        base += len(text) + 1
                        at += 1
                    base = 0
            else:
                rows = [(UNKNOWN, 0.0, [])] * len(texts)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, LABELLED)


def _document(text: bytes, path: np.ndarray, weight: np.ndarray, starts: np.ndarray, stops: np.ndarray, names: list[str]) -> tuple:
    if not weight.any():
        return UNKNOWN, 0.0, []
    shares = np.bincount(path, weight, len(names))
    best = int(shares.argmax())
    turn = np.flatnonzero(np.diff(path, prepend=-1))
    if text.isascii():
        place = np.arange(len(text) + 1)
    else:
        place = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    last = np.concatenate((turn[1:], [len(path)])) - 1
    spans = [{"start": int(place[starts[a]]), "end": int(place[stops[b]]), "lang": names[path[a]]} for a, b in zip(turn.tolist(), last.tolist(), strict=True)]
    return names[best], float(shares[best] / shares.sum()), spans


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
