"""Secrets in whole texts: a trigram index picks the rules that a document is tried on.

From each rule's regular expression a Boolean query over trigrams is derived that every match must
satisfy (after Cox, "Regular Expression Matching with a Trigram Index").  The index is inverted by
literal: the trigrams of a literal that some query names lead to the documents that hold them all.
Its postings are written beside each document in the scan that reads the text, a trigram being
sought only if those before it in its literal were found; a rule's clauses are intersected there,
and the rule is verified on its candidates only, in the same pass.  (A table of postings of its
own would have to meet whole texts again.)  Rules whose query is empty, as that for runs of
hexadecimal digits, scan all documents.

Spans are [start, end) in code points.  A kind's matches are the leftmost ones that do not overlap;
those that are too short are dropped after matching.  Places come from running sums over the
matches and what lies between them, taken by doubling: n matches cost n log n.

Cases: a null or empty text has no spans; very long texts are read whole, however many matches they
hold.  Each row has its own result, whether its doc_id is null or that of other rows.  An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that must have at least `least` characters
    least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
#: The three kinds that the counts and the digest are about.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 and more are the runs of one and more that aren't too short
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the index makes cheap to add.
ADDED = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Strings that a part of a pattern may stand for, before its trigrams are taken.
MOST_STRINGS = 24

Query = list[list[frozenset[str]]]  # all of the clauses; of a clause any set; of a set all trigrams


def trigram_query(pattern: str) -> Query:
    """What the lower-cased trigrams of a text must satisfy if the pattern matches in it."""
    clauses: Query = []

    def flush(strings: set[str]) -> set[str]:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            clauses.append(sorted(sets, key=sorted))
        return {""}

    def strings_of(part) -> set[str] | None:
        """All strings, lower-cased, that a part matches, if they are few."""
        name, value = str(part[0]), part[1]
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if name == "SUBPATTERN":
            return of_sequence(value[-1])
        if name == "BRANCH":
            each = [of_sequence(x) for x in value[1]]
            return None if None in each else set().union(*each)
        if name == "MAX_REPEAT" and value[1] == 1 and (inner := of_sequence(value[2])) is not None:
            return inner | {""} if value[0] == 0 else inner
        return None

    def of_sequence(parts) -> set[str] | None:
        whole = {""}
        for part in parts:
            own = strings_of(part)
            if own is None or len(whole) * len(own) > MOST_STRINGS:
                return None
            whole = {a + b for a in whole for b in own}
        return whole

    def walk(parts) -> None:
        now = {""}
        for part in parts:
            own = strings_of(part)
            if own is not None and "" not in own and len(now) * len(own) <= MOST_STRINGS:
                now = {a + b for a in now for b in own}
                continue
            now = flush(now)
            if own is not None and "" not in own:
                now = own
            elif str(part[0]) == "SUBPATTERN":
                walk(part[1][-1])
            elif str(part[0]) == "MAX_REPEAT" and part[1][0] > 0:
                walk(part[1][2])
        flush(now)

    walk(list(re._parser.parse(pattern)))
    return clauses


def postings(low: Column, literals: list[frozenset[str]]) -> Column:
    """For each literal (a set of trigrams), whether a lower-cased text holds all its trigrams."""
    return F.array(*(reduce(and_, (low.contains(x) for x in sorted(own))) for own in literals))


def candidates(held: Column, rules: list[Query], literals: list[frozenset[str]]) -> Column:
    """For each rule, whether a document's postings satisfy its query.  An empty query always holds."""
    number = {own: n for n, own in enumerate(literals)}
    holds = lambda query: reduce(and_, (reduce(or_, (F.get(held, number[own]) for own in clause)) for clause in query), F.lit(True))
    return F.array(*map(holds, rules))


def running_sums(values: Column) -> Column:
    """Sums of an array's elements up to each.  In each of log n steps an element takes on the sum
    of as many before it as it has itself, so that no array is built an element at a time."""
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    reach = lambda k: F.call_function("shiftleft", F.lit(1), k)
    doubled = lambda now, k: F.transform(now, lambda x, i: x + F.when(i >= reach(k), F.get(now, i - reach(k))).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), steps), values, doubled)


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def matches(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, from what a split leaves between them
    and what they hold."""
    pattern = F.lit(rule.pattern)
    lengths = lambda x: F.transform(x, lambda s: F.length(s))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    secrets = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # a gap comes before each hit, and one more follows the last
    both = F.zip_with(lengths(F.split(text, rule.pattern, -1)), lengths(hits), lambda gap, hit: gap + F.coalesce(hit, F.lit(0)))
    spans = F.zip_with(F.zip_with(running_sums(both), hits, lambda end, hit: F.struct(end.alias("end"), F.length(hit).alias("n"))), secrets, lambda x, s: F.struct((x["end"] - x["n"]).alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), (F.length(s) >= rule.least).alias("long")))
    found = F.transform(F.filter(spans, lambda x: F.coalesce(x["long"], F.lit(False))), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(NO_SPANS))


def rendered(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(number: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == number)).cast("long")


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256, spans, secrets: a row for each row of docs.

    secrets is array<struct<start, kind, end>> by start and then by the rules' order.
    """
    rules = [*base, *added]
    queries = [trigram_query(r.pattern) for r in rules]
    literals = sorted({own for q in queries for clause in q for own in clause}, key=sorted)
    # a step each, so that what the next one uses often is computed once
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", "text", postings(F.col("low"), literals).alias("held"))
    rows = rows.select("doc_id", "text", candidates(F.col("held"), queries, literals).alias("rules"))
    tried = [F.when(F.get("rules", n), matches(F.col("text"), n, rule)).otherwise(F.expr(NO_SPANS)) for n, rule in enumerate(rules)]
    found = rows.select("doc_id", F.sort_array(F.concat(*tried)).alias("secrets"))
    kinds = [r.kind for r in rules]
    counts = [_count_of(n).alias(f"n_{r.kind}") for n, r in enumerate(base)]
    of_base = F.filter("secrets", lambda s: s["kind"] < len(base))
    return found.select("doc_id", *counts, F.sha2(rendered(of_base, kinds), 256).alias("base_sha256"), rendered(F.col("secrets"), kinds).alias("spans"), "secrets")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents")).drop("secrets")
