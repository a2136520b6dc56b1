import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylink.llm import common, minhash_dedup, shingles
from entitylink.llm.components import components
from entitylink.llm.exact_dedup import digests, drop_copies, exact_groups, exchange
from entitylink.llm.minhash_dedup import between, drop_near_copies, near_groups, sketches

from .helpers import documents, odd_rows


def lowered(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize(("keep", "runs", "fan_in"), [("max", 8, 2), ("min", 8, 2), ("min", 16, 4), ("max", None, 4)])
def test_exact_groups(spark, keep, runs, fan_in):
    rows = [*odd_rows(), (-(1 << 63), "ONE"), ((1 << 63) - 1, "One")]
    got = exact_groups(documents(spark, rows), keep=keep, runs=runs, fan_in=fan_in).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lowered(t)).hexdigest()].append(i)
    assert len(got) == len(rows)
    for digest, ids in groups.items():
        own = [r for r in got if r.text_sha256 == digest]
        named = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(named) if named else None
        assert Counter(r.doc_id for r in own) == Counter(ids)
        assert {r.group_size for r in own} == {len(ids)} and {r.keep_id for r in own} == {best}
        assert sum(r.kept for r in own) == 1
        assert all(r.doc_id == best for r in own if r.kept)


def test_drop_copies_keeps_columns_and_one_row(spark):
    docs = documents(spark, [*odd_rows(), (7, "another text under the same id")])
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(lowered(r.text) for r in left.collect()) == Counter({lowered(t) for t in [*(t for _, t in odd_rows()), "another text under the same id"]})
    assert drop_copies(documents(spark, [])).count() == 0


def test_rounds_bring_few_rows_of_a_digest_together(spark):
    """After each round, the runs that are left for a digest are as many as its bits leave open."""
    docs = documents(spark, [(i, "the same") for i in range(300)])
    rows = digests(docs, "doc_id", "text", 16).withColumn("_best", F.struct(F.lit(True).alias("first"), "doc_id", F.col("_run").alias("run"))).withColumn("_size", F.lit(1))
    runs = rows.groupBy("_run", "_sha", "_bytes", "_xx").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    left = [runs.count()]
    for k in range(4):
        runs = exchange(runs, 1 << k, "max")
        left.append(runs.count())
    assert left == [16, 8, 4, 2, 1] and runs.head()._best.doc_id == 299 and runs.head()._size == 300


def test_drop_copies_leaves_columns_of_its_own_names_alone(spark):
    names = ["_id", "_of", "_sha", "_row", "_won", "_run", "_size", "_best", "kept"]
    rows = [(7, "a text", *names), (7, "a text", *names), (7, "other", *names), (8, "other", *names), (None, "a text", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = sorted(drop_copies(docs).collect())
    assert left == [(7, "a text", *names), (8, "other", *names)] and drop_copies(docs).columns == docs.columns


def brute_components(rows, width, percent):
    sets = {i: shingles.plain_set((t or "").encode(), width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in ids}


def varied(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own) if i % 7 else " ".join(own).upper()))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "alone"), (n + 4, "ALONE"), (n + 5, "a b")]


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_like_brute_force(spark, width):
    rows = varied(width, 180)
    got = {r.doc_id: r for r in near_groups(documents(spark, rows), width=width).collect()}
    want = brute_components(rows, width, 80)
    assert {i: (r.component_id, r.n_shingles) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_groups_odd_rows(spark):
    rows = odd_rows()
    got = near_groups(documents(spark, rows), width=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[5] == 4 and of[7] == 6 and of[1] == 1 and of[2] == 2 and of[3] == 3
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_groups(documents(spark, [])).count() == 0


def test_drop_near_copies(spark):
    docs = documents(spark, [(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, "other words altogether here now")])
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_drop_near_copies_row_by_row(spark):
    """A text that nobody else has stays, even under the id of a row that goes; so do other columns."""
    text = "a b c d e f g h i j"
    rows = [(1, text), (2, text.upper()), (2, "a text that nobody else has here"), (2, "a text that nobody else has here"), (None, text), (None, None), (3, None), (3, "")]
    docs = documents(spark, rows).withColumnsRenamed({"score": "_of", "row": "_id", "shard": "node"})
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    assert kept == Counter([(1, text), (2, "a text that nobody else has here"), (None, text), (None, None), (3, None), (3, "")])
    plain = docs.dropDuplicates(["doc_id"])
    assert drop_near_copies(plain).columns == docs.columns


def test_a_large_bucket_is_dealt_to_cells(spark, monkeypatch):
    """Groups of near copies with cells of a few nodes, large stars and copied texts, as brute force has them."""
    monkeypatch.setattr(minhash_dedup, "CELL_NODES", 8)
    monkeypatch.setattr(minhash_dedup, "LOOKED_AT", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(11)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(50)) for _ in range(80)]
    rows = varied(9, 60)
    for i in range(100, 190):
        own = list(base)
        own[rng.randrange(80)] = f"x{i % 45}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_groups(documents(spark, rows), width=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_prefix_join_finds_all_pairs(spark):
    rows = [(i, t) for i, t in varied(3, 90) if t and t.strip()]
    sets = {i: shingles.plain_set(t.encode(), 2) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    buckets = spark.createDataFrame([(1, i) for i in sets], "key long, node long")
    labels = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    texts = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "node long, body binary")
    flat, each = shingles.shingle_sets([t.encode() for _, t in rows], 2)
    nodes = spark.createDataFrame([(i, n, s) for (i, _), n, s in zip(rows, each.tolist(), sketches(flat, each).tolist(), strict=True)], "node long, n long, sketch array<long>")
    found = {(r.a, r.b) for r in between(buckets, labels, nodes, texts, 2, 80).collect()}
    assert links <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_words_hash_alike_wherever_they_stand():
    texts = [b"The  the\tTHE\nx", b"", None, b" the", "é É the".encode()]
    hashed, each = shingles.words(texts)
    assert each.tolist() == [4, 0, 0, 1, 3]
    assert len({hashed[0], hashed[1], hashed[2], hashed[4], hashed[7]}) == 1
    assert len(np.unique(hashed)) == 4
