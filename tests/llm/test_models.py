import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from entitylink.llm import language_id, lm_scoring, quality, shingles

from .helpers import documents, odd_rows


def sentence(rng, good=True):
    words = ["river", "stone", "garden", "window", "summer", "quiet", "letter", "bridge", "morning", "paper"]
    own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
    return " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own)


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = [(100 + i, sentence(rng, i % 4 > 0)) for i in range(n)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(0, n, 2)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, [*rows, *odd_rows()])
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i].kept == (n % 4 > 0) for n, (i, _) in enumerate(rows) if n % 2)
    assert all(0 <= r.score <= 1 for r in got.values())
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect() if r.doc_id and r.doc_id >= 100} == {i for n, (i, _) in enumerate(rows) if n % 4}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, odd_rows())
    assert [r.score for r in quality.classify(docs, none).collect()] == [1.0] * len(odd_rows())
    assert quality.keep_good(documents(spark, []), none).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(2000) < 0.5, 1.0, 0.0)
    x = rng.normal(size=(2000, 5)) + 2.5 * (2 * y - 1)[:, None] * np.array([1, 1, 0, 0, 0])
    z = rng.normal(size=(2000, 3)) + 2.5 * (2 * y - 1)[:, None] * np.array([1, 0, 0])
    alone = quality.co_train(x[:60], z[:60], y[:60], None, rounds=0)
    model = quality.co_train(x[:60], z[:60], y[:60], lambda m: m.lessons(x[60:], z[60:], 0.98))
    right = [((m.score(x[60:], z[60:])[k] > 0.5) == (y[60:] > 0.5)).mean() for m in (alone, model) for k in range(3)]
    assert right[5] > 0.97 and right[3] >= right[0] - 0.005 and right[4] >= right[1] - 0.005


def test_quality_like_brute_force(spark):
    """The fit and all scores against the same done on one machine, row after row."""
    rows, labels = labelled(spark, 300)
    rows = [(i, t, None if n % 29 == 0 else "en" if n % 4 else "fr") for n, (i, t) in enumerate([*rows, *odd_rows()])]
    docs = documents(spark, rows)
    marked = {i: int(n % 4 > 0) for n, (i, _, _) in enumerate(rows[:300]) if n % 2 == 0}
    features = [(quality.content_features([t.encode() if t else None])[0].astype(float), quality.meta_features([lang], ["src"], [len(t) if t is not None else None])[0].astype(float)) for _, t, lang in rows]
    own = sorted((n for n in range(300) if rows[n][0] in marked), key=lambda n: (zlib.crc32(str(rows[n][0]).encode()), rows[n][0]))
    rest = [n for n in range(len(rows)) if rows[n][0] not in marked]

    def lessons(model):
        total = None
        for n in rest:
            one = model.lessons(features[n][0][None], features[n][1][None], 0.98)
            total = one if total is None else tuple(a + b for a, b in zip(total, one, strict=True))
        assert total[0][0] > 20 and total[1][0] > 20
        return total

    x, z = (np.stack([features[n][k] for n in own]) for k in range(2))
    model = quality.co_train(x, z, np.array([marked[rows[n][0]] for n in own], float), lessons)
    want = sorted((str(rows[n][0]), *(float(v[0]) for v in model.score(features[n][0][None], features[n][1][None]))) for n in range(len(rows)))
    got = sorted((str(r.doc_id), r.p_content, r.p_meta, r.score) for r in quality.classify(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-4)


def test_quality_repeated_ids_and_labels_of_missing_documents(spark):
    rows, labels = labelled(spark, 200)
    gone = spark.createDataFrame([(100_000 + i, i % 2, 0) for i in range(500)], labels.schema)
    docs = documents(spark, [*rows, *rows[:40], (100, "another text under a labelled id"), *odd_rows()])
    some = quality.classify(docs, labels.union(gone), labelled=100).collect()
    assert len(some) == len(rows) + 40 + 1 + len(odd_rows())
    assert {(r.doc_id, round(r.score, 9)) for r in some if r.doc_id and r.doc_id > 110} == {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, labels, labelled=100).collect() if r.doc_id and r.doc_id > 110}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        each = rng.integers(0, 7, 5)
        scores = rng.normal(size=(int(each.sum()), 3)) * 4
        path, low = language_id.viterbi(scores, each, 3.0), 0
        for n in each.tolist():
            own = scores[low : low + n]
            value = lambda p, own=own, n=n: sum(own[i, p[i]] for i in range(n)) - 3 * sum(p[i] != p[i - 1] for i in range(1, n))
            best = max((value(p) for p in itertools.product(range(3), repeat=n)), default=0)
            assert value(path[low : low + n]) == pytest.approx(best)
            low += n


@pytest.mark.parametrize("languages", [3, 128, 129, 200, 257, 70_000])
def test_viterbi_with_many_languages(languages):
    scores = np.full((4, languages), -9.0)
    scores[:, languages - 1] = 0
    assert language_id.viterbi(scores, np.array([4]), 3.0).tolist() == [languages - 1] * 4


WORDS = {
    "en": "the and with that house which never thought would through".split(),
    "de": "und nicht schön über haus straße werden durch gewöhnlich zwischen".split(),
    "ru": "это дом который никогда думал через сквозь город вечер".split(),
}


def spoken(rng, lang, n=25):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_held_out_and_spans(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, lang), lang) for i, lang in zip(range(2000, 2300), itertools.cycle(WORDS), strict=False)]
    model = language_id.learn(documents(spark, rows))
    mixed = spoken(rng, "en") + " " + spoken(rng, "de")
    extra = [*odd_rows(), (1000, mixed, None), (1001, "12 34 !?", None), (1002, "Ünd " + spoken(rng, "ru"), None)]
    got = {r.doc_id: r for r in language_id.identify(documents(spark, [*rows, *extra]), model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(unseen) > 40 and all(got[i].lang_pred == lang for i, _, lang in unseen)
    assert [s.lang for s in got[1000].spans] == ["en", "de"]
    cut = mixed[got[1000].spans[0].start : got[1000].spans[0].end]
    assert set(cut.split()) <= set(WORDS["en"])
    assert got[1002].lang_pred == "ru"
    for i in (1, 2, 3, 10, 1001):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(documents(spark, []), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents(spark, rows[:3]), None).collect()} == {"und"}


def test_language_ignores_held_out_labels(spark):
    rows = [(i, spoken(random.Random(i), "en"), "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en") for i in range(40)]
    assert language_id.learn(documents(spark, rows)).languages == ["en"]
    assert language_id.learn(documents(spark, [(1, "no label", None)])) is None


def test_lm_like_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, i % 3 > 0)) for i in range(40)] + [(100 + i if i is not None else None, t) for i, t in odd_rows() if t is None or len(t) < 1000]
    labels = spark.createDataFrame([(i, 1, 0 if i % 2 else 1) for i in range(40)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(40) if i % 2} - {7}
    got = lm_scoring.score_documents(documents(spark, rows), labels).collect()
    tokens = [(i, [int(h) for h in shingles.words([(t or "").encode()])[0]]) for i, t in rows]
    word_of = lambda h: h >> (64 - lm_scoring.WORD_BITS)
    pairs_of = lambda own: [int(p) for p in lm_scoring.buckets([b""], 1, 1)[1]] if not own else own
    counts = [Counter(), Counter()]
    pair_counts = [Counter(), Counter()]
    for i, own in tokens:
        for k in range(2):
            if k == 0 or i in good:
                counts[k].update(map(word_of, own))
                pair_counts[k].update(zip(own, own[1:], strict=False))
    entries, mix = 1 << lm_scoring.WORD_BITS, 0.3
    want = defaultdict(list)
    for i, own in tokens:
        mine, my_pairs = Counter(map(word_of, own)), Counter(zip(own, own[1:], strict=False))
        means = []
        for k in (1, 0):
            out = k == 0 or i in good
            total = 0.0
            for n, h in enumerate(own):
                w = word_of(h)
                alone = (counts[k][w] - out * mine[w] + 1) / (sum(counts[k].values()) - out * len(own) + entries)
                seen = 0
                if n:
                    v = word_of(own[n - 1])
                    seen = counts[k][v] - out * mine[v]
                if seen > 0:
                    pair = (own[n - 1], h)
                    after = min(1.0, (pair_counts[k][pair] - out * my_pairs[pair]) / seen)
                    total -= math.log((1 - mix) * after + mix * alone)
                else:
                    total -= math.log(alone)
            means.append(total / len(own) if own else None)
        want[i].append((len(own), *means))
    assert pairs_of([1]) == [1]
    for r in got:
        close = [w for w in want[r.doc_id] if w[0] == r.n_tokens and (w[1] is None) == (r.target_loss is None) and (w[1] is None or abs(w[1] - r.target_loss) < 1e-6 and abs(w[2] - r.background_loss) < 1e-6)]
        assert close, (r, want[r.doc_id])
        assert (r.loss_difference is None) == (r.n_tokens == 0)
    assert len(got) == len(rows)


def test_lm_counts_every_word_and_pair_apart(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.2)) % 40_000}" for _ in range(300))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    counts, pair_counts, sizes = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, text in rows:
        own = text.split()
        for k in range(2 if i % 3 else 1):
            counts[k].update(own)
            pair_counts[k].update(itertools.pairwise(own))
            sizes[k] += len(own)
    entries = len(counts[0])
    assert entries > 10_000
    got = lm_scoring.score_documents(documents(spark, rows), labels, least_entries=1, chunk_bytes=50_000, bucket_bytes=90_000).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    for r in got:
        own = rows[r.doc_id][1].split()
        mine, my_pairs, means = Counter(own), Counter(itertools.pairwise(own)), []
        for k in (1, 0):
            out, total = k == 0 or r.doc_id % 3 > 0, 0.0
            for n, w in enumerate(own):
                alone = (counts[k][w] - out * mine[w] + 1) / (sizes[k] - out * len(own) + entries)
                v = own[n - 1] if n else None
                seen = counts[k][v] - out * mine[v] if n else 0
                total -= math.log(0.7 * (pair_counts[k][v, w] - out * my_pairs[v, w]) / seen + 0.3 * alone if seen > 0 else alone)
            means.append(total / len(own))
        assert (r.target_loss, r.background_loss) == pytest.approx(means)


def plain_words(text):
    """Words with the buckets of their 4-grams, their letters and the largest lead byte's script."""
    for word in re.split("[ \\t-\\r]+", text.lower()):
        if word:
            own = b"   " + word.encode() + b" "
            grams = [int.from_bytes(own[i : i + 4], "big") * 2654435761 % (1 << 32) >> (32 - language_id.BITS) for i in range(len(own) - 3)]
            yield grams, sum(c.isalpha() for c in word), max(int(language_id._SCRIPT[b]) for b in word.encode())


def test_language_counts_and_scores_like_brute_force(spark):
    rng = random.Random(8)
    say = {
        "en": lambda: rng.choice(["the", "WORDS", "of", "men", "shining", "12", "it's"]),
        "fr": lambda: rng.choice(["Élan", "été", "les", "maisons", "où", "garçon", "—"]),
        "ru": lambda: rng.choice(["Слово", "дом", "река", "ЛЕС", "и"]),
        "el": lambda: rng.choice(["λόγος", "Σπίτι", "και"]),
    }
    rows = [(i, " ".join(say[lang]() for _ in range(rng.randrange(1, 12))), lang) for i in range(120) for lang in [rng.choice(list(say))]]
    rows += [(200 + i, " ".join(say[rng.choice(list(say))]() for _ in range(20)), None) for i in range(20)]
    rows += [(300, "😀 — 12", None), (301, "Дом дом the the the the", None), (302, "İstanbul the men", None)]
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    languages = sorted({r[2] for r in learned})
    counts, scripts = {lang: Counter() for lang in languages}, {lang: Counter() for lang in languages}
    for _, text, lang in learned:
        for grams, n, script in plain_words(text):
            if n:
                counts[lang].update(grams)
                scripts[lang][script] += 1
    size = 1 << language_id.BITS
    score = lambda lang, g: math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * size))
    allowed = {s: {lang for lang in languages if s == 0 or scripts[lang][s] >= 0.001 * max(1, sum(scripts[lang].values()))} or set(languages) for s in range(len(language_id.SCRIPTS) + 1)}
    model = language_id.learn(documents(spark, rows))
    assert model.languages == languages
    got = {r.doc_id: r for r in language_id.identify(documents(spark, rows), model).collect()}
    for i, text, _ in rows:
        paths = {lang: (0.0, ()) for lang in languages}
        weights = []
        for k, (grams, n, script) in enumerate(plain_words(text)):
            weights.append(n)
            own = {lang: (sum(score(lang, g) for g in grams) - (0 if lang in allowed[script] else 1e4)) if n else 0.0 for lang in languages}
            best = max(total for total, _ in paths.values())
            switch = next(p for t, p in paths.values() if t == best)
            paths = {lang: ((t, p) if not k or t >= best - 8.0 else (best - 8.0, switch)) for lang, (t, p) in paths.items()}
            paths = {lang: (t + own[lang], (*p, lang)) for lang, (t, p) in paths.items()}
        if not sum(weights):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        path = max(paths.values(), key=lambda x: x[0])[1]
        shares = {lang: sum(n for n, own in zip(weights, path, strict=True) if own == lang) for lang in languages}
        assert got[i].lang_pred == max(languages, key=lambda x: shares[x]), (text, path)
        assert got[i].score == pytest.approx(shares[got[i].lang_pred] / sum(weights))
    assert got[301].lang_pred == "en" and got[301].score == pytest.approx(12 / 18)


def test_letters_and_lower_case():
    text = "Éa— 😀𝒳ßİ Ж1".encode()
    data, ends = language_id.joined([text])
    assert ends[0] == len(data) and data.tobytes() == "éa— 😀𝒳ßİ ж1 ".encode()
    assert language_id.letters(data).sum() == sum(c.isalpha() for c in text.decode())
