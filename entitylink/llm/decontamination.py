"""Benchmark passages in documents, by spaced seeds.

Words are runs of letters and digits, lower-cased.  A seed is the hash of the words that a fixed
mask keeps in a window, so a word changed at an ignored position does not hide the window.  The
seeds of the benchmark meet those of every window of every document; around a hit, the words of
document and item are laid side by side on the hit's diagonal, and the hit counts if some stretch
of `window` words that holds the seed (the whole item, if it is shorter) agrees in `percent` of its
places.  The masks for a length of stretch leave a seed whole wherever the words that may differ
stand, so no stretch that would count is missed; items of fewer than five words must stand whole.

The benchmark is the stated query set: its seeds are broadcast in blocks of a checked number of
rows, and every block is joined with all windows.  Documents are read once for each block and not
shuffled; verified hits, of a few numbers each, are.

Cases: null or empty texts have no windows; very long ones have one for each word, a row at a time.  Repeated rows are reported once.  Rows with a null
doc_id are reported together under null.  Items with null text, an empty benchmark or an empty
table give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, materialize, read, without

#: Kept (1) and ignored (0) words, by how long a stretch is and how many of its words may differ:
#: wherever those stand, some mask fits into the stretch at some place and ignores them all.
MASKS = {
    (5, 1): ("111", "1101"),
    (6, 1): ("1111", "11011"),
    (7, 1): ("11111", "110111", "111101"),
    (8, 1): ("111011", "110111"),
    (9, 1): ("111011",),
    (10, 2): ("111011", "11010011", "11111"),
    (11, 2): ("1101011", "1110011"),
    (12, 2): ("11101011", "101100111", "1111011"),
    (13, 2): ("11101011", "110100111"),
}


def masks_for(n: int, percent: int) -> tuple[str, ...]:
    """Masks that find every stretch of n words that agrees in `percent` of its places."""
    differ = n - -(-n * percent // 100)
    # of differ + 1 parts side by side, one is whole
    return MASKS.get((n, differ), ("1" * max(1, n // (differ + 1)),))


def word_hashes(text: Column) -> Column:
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seed(words: Column, start: Column, mask: str) -> Column:
    """The hash of the words that the mask keeps of those from `start` on; null where it runs over
    the end."""
    kept = [F.get(words, start + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(start + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


def windows(rows: DataFrame, words: str, masks: tuple[str, ...]) -> DataFrame:
    """rows with _pos (the word at which a window starts), _span and seed: a row for each word and
    mask.  Words come first and masks next, so that seeds are compiled and not computed in a lambda."""
    placed = rows.select(*rows.columns, F.posexplode(words).alias("_pos", "_word")).drop("_word")
    each = F.explode(F.array(*(F.struct(F.lit(len(m)).alias("span"), seed(F.col(words), F.col("_pos"), m).alias("seed")) for m in masks)))
    return placed.withColumn("_seed", each).select(*rows.columns, "_pos", F.col("_seed.span").alias("_span"), F.col("_seed.seed").alias("seed"))


def chosen_masks(items: DataFrame, window: int, percent: int) -> dict[int, tuple[str, ...]]:
    """The masks for items of at least `window` words, and for each length of shorter ones."""
    lengths = items.select(F.least(F.lit(window), F.size("_item")).alias("n")).distinct()
    return {r["n"]: masks_for(r["n"], percent) for r in lengths.orderBy("n").collect()}  # no more than window rows


def item_seeds(items: DataFrame, masks: dict[int, tuple[str, ...]], window: int) -> DataFrame:
    """seed, _key, at (the word at which the window starts), span."""
    tables = [items.selectExpr("0L as seed", "_key", "0 as at", "0 as span").limit(0)]
    for length, chosen in masks.items():
        own = items.filter(F.least(F.lit(window), F.size("_item")) == length).select("_key", "_item")
        tables.append(windows(own, "_item", chosen).filter("seed is not null").select("seed", "_key", F.col("_pos").alias("at"), F.col("_span").alias("span")))
    return reduce(DataFrame.unionByName, tables)


def agreement(words: Column, item: Column, diagonal: Column, at: Column, span: Column, window: int, percent: int) -> Column:
    """For the stretches of `window` places that hold the seed and agree in enough of them: the
    most words that agree, and the first that does.  An array of one struct, or of none."""
    n = F.least(F.lit(window), F.size(item))
    low, high = F.greatest(F.lit(0), at + span - n), F.least(at, F.size(item) - n)
    same = lambda i: F.coalesce(F.get(words, diagonal + i) == F.get(item, i), F.lit(False))
    total = lambda s: F.aggregate(F.sequence(s, s + n - 1), F.lit(0), lambda sums, i: sums + same(i).cast("int"))
    sums = F.transform(F.sequence(low, high), lambda s: F.struct(total(s).alias("agreeing"), s.alias("low")))
    enough = F.filter(sums, lambda x: x["agreeing"] * 100 >= n * percent)
    first = lambda s: F.get(F.filter(F.sequence(s, s + n - 1), same), F.lit(0))
    return F.transform(
        F.filter(F.array(enough), lambda e: F.size(e) > 0),
        lambda e: F.struct(F.array_max(e)["agreeing"].alias("agreeing"), (diagonal + first(F.get(e, F.lit(0))["low"])).alias("first")),
    )


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 80, least: int = 1, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_hits, words_agreeing, first_word: a row for each document and item.

    least: leaves out items of fewer words, for a benchmark whose short answers are plain words."""
    items = materialize(benchmark.select("item_id", word_hashes(F.col("text")).alias("_item")).filter(f"size(_item) >= {least}").withColumn("_key", F.xxhash64("item_id", "_item")).dropDuplicates(["_key"]))
    by_length = chosen_masks(items, window, percent)
    masks = tuple(dict.fromkeys(m for chosen in by_length.values() for m in chosen))
    wanted = materialize(item_seeds(items, by_length, window))
    blocks = max(1, -(-wanted.count() // block_rows))
    words_in_items = items.agg(F.coalesce(F.sum(F.size("_item")), F.lit(0))).head()[0]
    texts = items.select("_key", "item_id", "_item")
    texts = F.broadcast(texts) if words_in_items <= BROADCAST_ROWS else texts
    seen = windows(docs.select("doc_id", word_hashes(F.col("text")).alias("_words")), "_words", masks or ("1",))
    found = []
    for k in range(blocks):
        block = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == k)
        # a block of twice the mean would need one seed to hold a whole block's rows
        hits = seen.join(F.broadcast(block) if blocks == 1 else bounded(block, 2 * block_rows), "seed").join(texts, "_key")
        hits = hits.withColumn("_diagonal", F.col("_pos") - F.col("at"))
        agreeing = agreement(F.col("_words"), F.col("_item"), F.col("_diagonal"), F.col("at"), F.col("span"), window, percent)
        found.append(hits.select("doc_id", "item_id", F.explode(agreeing).alias("_found")).select("doc_id", "item_id", "_found.agreeing", "_found.first"))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_hits"), F.max("agreeing").alias("words_agreeing"), F.min("first").alias("first_word"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark passage, each row by itself, whether its doc_id is
    null or that of other rows; columns as they were, whatever their names."""
    name = F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text"))
    found = find_passages(docs.select(name.alias("doc_id"), docs["text"]), benchmark, **options).select("doc_id").distinct()
    rows = docs.select(name.alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_of"))
    return without(rows, materialize(found)).select("_of.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_hits")
