import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylink.llm.sharding import jump_hash, jumps, shard_documents

from .helpers import documents, odd_rows


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def stable(doc_id):
    return int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("shards", [1, 8, 9, 100, 20_000])
def test_jump_hash_like_the_published_loop(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(stable(i) for i in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
    assert all(r.s == jump(r.k & (2**64 - 1), shards) for r in got)


def test_long_walks_end_where_short_ones_do(spark):
    keys = [stable(i) for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jumps(F.col("k"), 50, soon=2).alias("w"))
    assert all((r.w.shard, 50 if r.w.next == 50 else r.w.shard) == (jump(r.k, 50), jump(r.k, 51)) for r in df.collect())


def test_whole_table(spark):
    rows = [*odd_rows(), *((i, f"text {i % 5}") for i in range(100, 600))]
    got = shard_documents(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(stable(r.doc_id), 8), jump(stable(r.doc_id), 9), "key")
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        own = [r.slot for r in got if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    moved = sum(r.shard != r.grown_shard for r in got)
    assert 0.05 < moved / len(got) < 0.2
    assert shard_documents(documents(spark, [])).count() == 0
