import itertools
import random
import re

import pytest

from entitylink.llm.decontamination import drop_contaminated, find_passages, masks_for

from .helpers import documents, odd_rows


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, items, window=13, percent=80, least=1):
    found = set()
    for i, text in rows:
        doc = words_of(text)
        for k, item_text in items:
            item = words_of(item_text)
            if len(item) < least:
                continue
            n = min(window, len(item))
            for d in range(-len(item) + 1, len(doc)):
                same = [0 <= d + q < len(doc) and doc[d + q] == item[q] for q in range(len(item))]
                if any(100 * sum(same[s : s + n]) >= percent * n for s in range(len(item) - n + 1)):
                    found.add((i, k))
    return found


def tables(spark, rng):
    vocabulary = [f"v{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([6, 9, 15, 30, 50])))) for k in range(20)]
    rows = []
    for i in range(120):
        own = say(60)
        if i % 3 == 0:
            passage = words_of(rng.choice(items)[1])
            if len(passage) >= 30:
                for at in range(4, len(passage), 11):  # substitutions
                    passage[at] = "changed"
            at = rng.randrange(40)
            own[at:at] = [w.upper() + "," for w in passage]
        rows.append((i, " ".join(own)))
    return rows, [*items, (100, None), (101, ""), (102, "v1 v2"), (103, "V7"), (104, "v3 v4 v5"), (105, "few words there"), (None, " ".join(say(20)))]


def test_like_brute_force(spark):
    rows, items = tables(spark, random.Random(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) >= 40
    for block_rows in (10**6, 300):
        got = find_passages(documents(spark, rows), benchmark, block_rows=block_rows).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_drop_and_odd_rows(spark):
    passage = "the quick brown fox jumps over the lazy dog while many birds sing in a tree"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(spark, [*odd_rows(), (20, f"before {passage.title()} after"), (20, "clean"), (None, passage), (None, "clean"), (21, "the quick brown fox only")])
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([i for i, _ in odd_rows() if i is not None] + [20, 21])
    assert [r.text for r in kept if r.doc_id == 20] == ["clean"]
    assert sorted(r.text or "" for r in kept if r.doc_id is None) == ["", "clean", "no id, some text"]
    clash = docs.withColumnsRenamed({"score": "_of", "row": "seed", "shard": "_pos"})
    assert drop_contaminated(clash, benchmark).columns == clash.columns and drop_contaminated(clash, benchmark).count() == len(kept)
    assert find_passages(clash, benchmark, least=17).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_passages(docs, none).count() == 0
    assert find_passages(documents(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 100])
@pytest.mark.parametrize("n", range(1, 16))
def test_masks_leave_a_seed_whole(n, percent):
    differ = max(k for k in range(n) if 100 * (n - k) >= percent * n)
    kept = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks_for(n, percent) for at in range(n - len(m) + 1)]
    assert all(any(own.isdisjoint(changed) for own in kept) for changed in itertools.combinations(range(n), differ))


def every_substitution(spark, lengths):
    rows, items, want = [], [], set()
    for n in lengths:
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changed in itertools.combinations(range(min(n, 13)), min(n, 13) - -(-min(n, 13) * 80 // 100)):
            # of a longer item only a stretch of 13 words stands in the document
            own = ["changed" if k in changed else w for k, w in enumerate(item[:13])]
            low = next(k for k in range(n) if k not in changed)
            want.add((len(rows), n, len(own) - len(changed), 3 + low))
            rows.append((len(rows), " ".join(["before"] * 3 + own + ["after"] * 3)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_passages(documents(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.words_agreeing, r.first_word) for r in got} == want and len(got) == len(want)


def test_every_substitution_in_short_items(spark):
    every_substitution(spark, range(1, 11))


def test_every_substitution_in_long_items(spark):
    every_substitution(spark, (11, 12, 13, 20))
