"""DuckDB SQL for the queries that SQL can express, over whole tables.

Packing, token files, language models and classifiers have none: they rest on a tokenizer or on
fitted models, and are tested against brute force, round trips or held-out rows.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Places of equal words on a diagonal of document and item; every stretch of `n` item words with
# enough of them counts.
ORACLES["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
bw AS (SELECT item_id, len(words) AS size, least(13, len(words)) AS n, unnest(words) AS word, unnest(range(len(words))) AS q FROM b),
met AS (SELECT doc_id, item_id, size, n, p - q AS diagonal, q FROM dw JOIN bw USING (word)),
dense AS (SELECT doc_id, item_id, size, n, diagonal FROM met GROUP BY ALL HAVING count(*) * 100 >= n * 80),
stretch AS (
  SELECT doc_id, item_id, n, diagonal, low, count(*) AS agreeing, min(q) AS q
  FROM (SELECT m.*, unnest(range(greatest(0, q - n + 1), least(q, size - n) + 1)) AS low FROM met m SEMI JOIN dense USING (doc_id, item_id, diagonal))
  GROUP BY ALL HAVING count(*) * 100 >= n * 80
)
SELECT doc_id, item_id, max(agreeing) AS words_agreeing, min(diagonal + q) AS first_word FROM stretch GROUP BY ALL
"""

ORACLES["op4_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) WHEN len(words) = 1 THEN words ELSE [] END AS s FROM w
),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT twoway.b, reach.seen FROM reach JOIN twoway ON twoway.a = reach.node)
SELECT doc_id, len(s) AS n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s
"""

ORACLES["op5_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


# Fixed values, written out here once more: kind, pattern, the group that has a least length, and that length.
_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
_BASE_KINDS = 3


def _secrets() -> str:
    found = []
    for number, (kind, pattern, group, least) in enumerate(_RULES):
        pattern = pattern.replace("'", "''")
        found.append(
            f"""SELECT doc_id, {number} AS kind, '{kind}' AS name, start, start + length(hit) AS stop FROM (
  SELECT doc_id, unnest(hits) AS hit, unnest(secrets) AS secret, unnest(list_transform(range(1, len(hits) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0)))::BIGINT AS start
  FROM (SELECT doc_id, string_split_regex(body, '{pattern}') AS gaps, regexp_extract_all(body, '{pattern}', 0) AS hits, regexp_extract_all(body, '{pattern}', {group}) AS secrets FROM d)
) WHERE length(secret) >= {least}"""
        )
    spans = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){}, '')"
    base = f" FILTER (WHERE kind < {_BASE_KINDS})"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{kind}" for n, (kind, *_) in enumerate(_RULES[:_BASE_KINDS]))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS ({' UNION ALL '.join(found)})
SELECT doc_id, {counts}, sha256({spans.format(base)}) AS base_sha256, {spans.format('')} AS spans FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


ORACLES["op6_secret_scan"] = _secrets()

# The generator of CRC-32 gives its table; the state of the jump hash, whose multiplier is the
# published one, is kept modulo 2**64; the rows of a shard are dealt to 1024 blocks.
ORACLES["op9_sharding"] = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))
),
d AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(t.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, t
),
jump(doc_id, shards, state, shard, next) AS (
  SELECT doc_id, shards, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::UHUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (8), (9)) v(shards)
  UNION ALL
  SELECT doc_id, shards, s, next, floor((next + 1) * (2147483648.0::DOUBLE / ((s // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS s FROM jump WHERE next < shards)
),
placed AS (SELECT doc_id, max(shard) FILTER (WHERE shards = 8)::INT AS shard, max(shard) FILTER (WHERE shards = 9)::INT AS grown_shard FROM jump GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id || '/' || text_crc32), 1, 8))::BIGINT % 1024, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM d JOIN placed USING (doc_id)
"""
