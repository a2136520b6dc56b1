import hashlib

import duckdb
import pytest

import corpus_pipeline
from entitylink.llm.oracles import ORACLES
from entitylink.llm.quality import classify

from .helpers import documents, odd_rows
from .test_dedup import brute_components


def test_stages_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in classify(docs, labels).collect() if r.kept}
    best = {}
    for i in sorted(left):
        best[hashlib.sha256((rows[i] or "").encode().lower()).digest()] = i
    left = set(best.values())
    near = brute_components([(i, rows[i]) for i in left], 5, 80)
    left = {i for i, (c, _) in near.items() if i == c}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    left -= {r[0] for r in con.sql(ORACLES["op3_decontamination"]).fetchall()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == left and left
    assert all(r.length <= corpus_pipeline.SEQUENCE for r in out)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture
def odd_dir(spark, tmp_path):
    """Tables with nulls, repeated ids and rows, very long and empty texts, and columns of any name."""
    passage = "the quick brown fox jumps over the lazy dog while many birds sing in a tree"
    rows = [*odd_rows(), (20, f"before {passage} after"), (20, "clean words under the same id"), (None, passage), (21, "one two three four five six seven"), (22, "One two three four five six seven!")]
    clash = {"score": "_of", "row": "_id", "shard": "piece"}
    documents(spark, rows).withColumnsRenamed(clash).write.parquet(f"{tmp_path}/documents.parquet")
    documents(spark, []).withColumnsRenamed(clash).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for where in (tmp_path, tmp_path / "empty"):
        spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        spark.createDataFrame([(None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return tmp_path, rows


def test_stages_on_odd_rows(spark, odd_dir):
    folder, rows = odd_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert "_of" in docs.columns and "piece" in docs.columns
    kept = docs.collect()
    texts = [(r.text or "").lower() for r in kept]
    # one of each text, none with the passage, copies in other letters and near copies gone
    plain = {(t or "").lower() for _, t in rows if "quick brown" not in (t or "")}
    assert set(texts) == plain and len(texts) == len(plain)
    assert {(r._of, r._id, r.piece) for r in kept} == {("x", 1, 2)}
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert len({(r.doc_id, r.ids_crc32, r.piece) for r in out}) == len(out) and all(r.length <= corpus_pipeline.SEQUENCE for r in out)
    assert {r.doc_id for r in out} == {r.doc_id for r in kept}


def test_run_on_empty_tables(spark, odd_dir):
    assert corpus_pipeline.run(spark, f"{odd_dir[0]}/empty").count() == 0
