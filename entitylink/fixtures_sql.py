"""Queries of the mapping library over the test tables, and the same in DuckDB SQL.

Index tables are made from the test tables by SQL that both engines run as it stands; the oracle
then spells out each adapter field by field.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import normalise, stem, text
from .operators.mapper import EntityMapper, concat, normalise_table, rank_table
from .operators.ner import extract_disease_entities, extract_drug_entities, names_by_suffix
from .plans import RawLUT, compare_schemas
from .sources import DiseaseCuration, DiseaseIndex, DrugIndex, TargetIndex
from .streaming import map_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- test tables as indexes -------------------------------------------------------------------

#: Labels with accents, Greek letters and codes, from the parts.
ACCENTED = "replace(replace(p_name, 'o', 'ö'), 'a', 'α')"


def disease_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('PART_', p_partkey) AS id",
        "p_name AS name",
        "array(concat(' ', p_name, ' ', p_type, ' ')) AS exactSynonyms",
        "array(p_brand) AS narrowSynonyms",
        "array(p_type, '') AS broadSynonyms",
        f"array({ACCENTED}) AS relatedSynonyms",
        "array(concat('PMID:', p_partkey), concat('orpha:', p_partkey % 50), concat('x:MESH_', p_partkey)) AS dbXRefs",
        "array(concat('ORDO_', p_partkey % 7)) AS obsoleteXRefs",
    )


def target_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "concat('T', s_suppkey) AS id",
        "concat(s_name, ' of ', n_name) AS approvedName",
        "concat('S', s_suppkey) AS approvedSymbol",
        "array(named_struct('label', concat('the ', n_name, ' supplying relations'))) AS nameSynonyms",
        "array(named_struct('label', concat('s-', s_nationkey, '/', s_suppkey))) AS symbolSynonyms",
        "cast(null AS array<struct<label: string>>) AS obsoleteNames",
        "array(named_struct('label', concat('OLD', s_suppkey))) AS obsoleteSymbols",
        "array(named_struct('id', concat('P', s_suppkey, '_', s_nationkey))) AS proteinIds",
        "array(named_struct('source', 'HGNC', 'id', concat(':', s_suppkey)), named_struct('source', 'signalP', 'id', 'x'), named_struct('source', 'other', 'id', concat('o', s_nationkey))) AS dbXrefs",
    )


def drug_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('C', c_custkey) AS id",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('CHEMBL', c_custkey) ELSE c_name END AS name",
        "CASE WHEN c_custkey % 6 = 0 THEN cast(null AS array<struct<label: string, source: string>>) "
        "ELSE array(named_struct('label', concat(c_name, ' Component of /', c_mktsegment), 'source', 'ChEMBL'), named_struct('label', concat('brand', c_custkey % 100), 'source', 'ChEMBL')) END AS tradeNames",
        "array(named_struct('label', concat('syn', c_custkey % 40), 'source', CASE c_custkey % 4 WHEN 0 THEN 'ChEMBL' WHEN 1 THEN 'AACT' ELSE 'other' END)) AS synonyms",
        "array(named_struct('source', 'DailyMed', 'ids', array(concat('dm%20', c_nationkey))), named_struct('source', 'EMA', 'ids', array(concat('http://e/EPAR/', c_nationkey), 'none')), "
        "named_struct('source', 'chEBI', 'ids', array(concat(':', c_custkey), 'second')), named_struct('source', 'drugbank', 'ids', cast(array() AS array<string>))) AS crossReferences",
    )


def curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('http://www.example.org/x/', CASE WHEN p_partkey % 5 = 0 THEN 'ORPHANET_' WHEN p_partkey % 11 = 0 THEN 'GONE_' ELSE 'PART_' END, p_partkey) AS SEMANTIC_TAG",
        "CASE p_partkey % 4 WHEN 0 THEN concat('x#A00.1 ', p_name) WHEN 1 THEN concat('y#Chapter IX ', p_name, ' ', p_type) WHEN 2 THEN '1)' ELSE concat(' ', p_name, ' ') END AS PROPERTY_VALUE",
    )


# --- SQL of the functions ---------------------------------------------------------------------

# Fixed values, written out here once more so that the SQL does not take them from what it checks.
SQL_GREEK, SQL_GREEK_LATIN = "αβγδεζηικλμνξπρτυω", "abgdezhiklmnxprtuo"
SQL_ACCENTED = "àèìòùáéíóúâêîôûäëïöüÀÈÌÒÙÁÉÍÓÚÂÊÎÔÛÄËÏÖÜãåõøÃÅÕØçñýÇÑÝ"
SQL_PLAIN = "aeiouaeiouaeiouaeiouAEIOUAEIOUAEIOUAEIOUaaooAAOOcnyCNY"
SQL_IRRELEVANT = "PMID|DOI:|ORCID|PERSON|ISBN|WIKIPEDIA|HTTP|QUANT|UM-BBD_PATHWAYID"
SQL_STOP_WORDS = (
    "about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has "
    "hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i'd i'll i'm i've if in "
    "into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very "
    "was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's "
    "with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()
# Measures of a stem and the suffixes of the Porter stemmer (Porter, 1980).
SQL_SOME = "^(?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
SQL_ONE = "^(?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*(?:[aeiouy][aeiou]*)?$"
SQL_TWO = "^(?:[^aeiou][^aeiouy]*)?(?:[aeiouy][aeiou]*[^aeiou][^aeiouy]*){2}"
SQL_VOWEL = "^(?:[^aeiou][^aeiouy]*)?[aeiouy]"
SQL_SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
SQL_DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
SQL_STEP2 = """ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate
alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log""".split()
SQL_STEP3 = "icate ic ative _ alize al iciti ic ical ic ful _ ness _".replace("_", "''").split()
SQL_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def sql_track(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    share = f"CASE WHEN {letters} > 0 THEN length(regexp_replace({x}, '[^A-Z]', '', 'g')) / {letters} END"
    return f"CASE WHEN NOT contains({x}, ' ') AND (length({x}) <= 6 OR (length({x}) <= 11 AND ({share}) > 0.5)) THEN 'symbol' ELSE 'term' END"


def sql_greek(x: str) -> str:
    return f"translate({x}, '{SQL_GREEK}', '{SQL_GREEK_LATIN}')"


def sql_spellings(x: str) -> str:
    return f"[translate({sql_greek(x)}, '{SQL_ACCENTED}', '{SQL_PLAIN}'), {sql_greek(x)}]"


def sql_symbol(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9_]', '', 'g'))"


def sql_words(x: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in ["a", "i", *SQL_STOP_WORDS, *(w[0].upper() + w[1:] for w in SQL_STOP_WORDS)])
    cut = f"regexp_split_to_array(coalesce({x}, ''), '[\\s\\-/:,;]+')"
    bare = f"list_transform({cut}, lambda w: regexp_replace(regexp_replace(w, '^[^\\w$.]+', ''), '\\W+$', ''))"
    kept = f"list_filter({bare}, lambda w: NOT list_contains([{words}], w))"
    return f"list_filter(list_transform({kept}, lambda w: lower(regexp_replace(w, '[^\\w\\d\\s]', '', 'g'))), lambda w: w <> '')"


def sql_stems(source: str) -> str:
    """CTEs from a relation tok(word) to stem7(word, s): the steps of the stemmer, one after another."""
    suffix = lambda s, names: f"regexp_extract({s}, '(?:{'|'.join(names)})$')"
    cut = lambda s, n: f"left({s}, length({s}) - {n})"
    match = lambda s, p: f"regexp_matches({s}, '{p}')"
    out = [f"s0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS s FROM {source})"]

    def step(n: int, body: str, extra: str = "NULL") -> None:
        out.append(f"s{n} AS (SELECT word, CASE WHEN length(s) <= 2 THEN s ELSE {body} END AS s FROM (SELECT word, s, {extra} AS x FROM s{n - 1}))")

    step(1, f"CASE WHEN {match('s', '(?:ss|i)es$')} THEN {cut('s', 2)} WHEN {match('s', '[^s]s$')} THEN {cut('s', 1)} ELSE s END")
    base = cut("s", "length(x)")
    mended = f"CASE WHEN {match(base, '(?:at|bl|iz)$')} OR {match(base, SQL_SHORT)} AND NOT {match(base, SQL_DOUBLE)} THEN {base} || 'e' WHEN {match(base, SQL_DOUBLE)} THEN {cut(base, 1)} ELSE {base} END"
    step(2, f"CASE WHEN x = 'eed' THEN CASE WHEN {match(base, SQL_SOME)} THEN {cut('s', 1)} ELSE s END WHEN x <> '' AND {match(base, SQL_VOWEL)} THEN {mended} ELSE s END", suffix("s", ("eed", "ed", "ing")))
    step(3, f"CASE WHEN s LIKE '%y' AND {match(cut('s', 1), SQL_VOWEL)} THEN {cut('s', 1)} || 'i' ELSE s END")
    for n, table_of in ((4, SQL_STEP2), (5, SQL_STEP3)):
        names = table_of[::2]
        pairs = ", ".join(f"'{a}': '{b}'" for a, b in zip(names, (x.strip("'") for x in table_of[1::2]), strict=True))
        step(n, f"CASE WHEN x <> '' AND {match(base, SQL_SOME)} THEN {base} || MAP {{{pairs}}}[x] ELSE s END", suffix("s", names))
    step(6, f"CASE WHEN {match('s', '[st]ion$')} THEN CASE WHEN {match(cut('s', 3), SQL_TWO)} THEN {cut('s', 3)} ELSE s END WHEN x <> '' AND {match(base, SQL_TWO)} THEN {base} ELSE s END", suffix("s", SQL_STEP4))
    one = cut("s", 1)
    step(7, f"CASE WHEN s LIKE '%e' AND ({match(one, SQL_TWO)} OR {match(one, SQL_ONE)} AND NOT {match(one, SQL_SHORT)}) THEN {one} ELSE s END")
    step(8, f"CASE WHEN s LIKE '%ll' AND {match('s', SQL_TWO)} THEN {cut('s', 1)} ELSE s END")
    out.append("stemmed AS (SELECT word, regexp_replace(s, '^Y', 'y') AS stem FROM s8)")
    return ",\n".join(out)


def sql_normalise(source: str, target: str) -> str:
    """CTEs from a relation with label and track to the same with the normalised key."""
    return f"""
{target}_labels AS (SELECT DISTINCT label, track FROM {source}),
{target}_words AS (SELECT label, unnest({sql_words('label')}) AS word FROM {target}_labels WHERE track = 'term'),
tok AS (SELECT DISTINCT word FROM {target}_words),
{sql_stems('tok')},
{target}_terms AS (SELECT label, string_agg(DISTINCT stem, '' ORDER BY stem) AS key FROM {target}_words JOIN stemmed USING (word) WHERE stem <> '' GROUP BY label),
{target} AS (
  SELECT l.label, l.track, CASE l.track WHEN 'symbol' THEN {sql_symbol('l.label')} WHEN 'term' THEN coalesce(t.key, '') END AS key
  FROM {target}_labels l LEFT JOIN {target}_terms t ON t.label = l.label
)"""


# --- functions --------------------------------------------------------------------------------

_WORDS = "SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents"


def words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("word")).distinct()


@query(f"WITH l AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT DISTINCT p_brand FROM part UNION {_WORDS}) SELECT label, {sql_track('label')} AS track FROM l")
def fn_determine_track(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = part.select("p_name").union(part.select("p_brand")).union(words(spark, sf_dir)).distinct().toDF("label")
    return labels.select("label", text.determine_track(F.col("label")).alias("track"))


@query(f"WITH w AS ({_WORDS}) SELECT word, array_to_string({sql_spellings('word')}, '|') AS spellings FROM w")
def fn_translate_alternatives(spark, sf_dir):
    return words(spark, sf_dir).select("word", F.array_join(text.alternatives(F.col("word")), "|").alias("spellings"))


_PREFIXED = "CASE p_partkey % 6 WHEN 0 THEN concat('x#A00.1 ', p_name) WHEN 1 THEN concat('a#b#Chapter IX ', p_name) WHEN 2 THEN concat(p_name, '#') WHEN 3 THEN concat('B12-Z ', p_name) ELSE p_name END"


@query(
    rf"""SELECT p_partkey, CASE WHEN contains(l, '#') THEN regexp_extract(list_last(string_split(l, '#')), '^(?:[A-Z][0-9]{{2}}[-.A-Z0-9]* |Chapter [IVX]+ )?(.+)$', 1) ELSE l END AS cleaned
FROM (SELECT p_partkey, {_PREFIXED} AS l FROM part)"""
)
def fn_clean_prefix(spark, sf_dir):
    labels = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PREFIXED} AS l")
    return labels.select("p_partkey", text.clean_prefix(F.col("l")).alias("cleaned"))


_IDENT = "CASE s_suppkey % 5 WHEN 0 THEN concat('MONDO_', s_suppkey) WHEN 1 THEN concat('http://x/ABC:EFO_', s_suppkey) WHEN 2 THEN concat('ORPHA:', s_suppkey) WHEN 3 THEN concat('ORDO_', s_suppkey) ELSE s_name END"
_SQL_IDENT = "regexp_replace(replace(CASE WHEN length(regexp_extract({x}, '^.+:(.+_.+)$', 1)) > 1 THEN regexp_extract({x}, '^.+:(.+_.+)$', 1) ELSE {x} END, '_', ':'), 'ORDO:|ORPHA:', 'ORPHANET:', 'g')"


@query(f"SELECT s_suppkey, {_SQL_IDENT.format(x='i')} AS identifier FROM (SELECT s_suppkey, {_IDENT} AS i FROM supplier)")
def fn_format_identifier(spark, sf_dir):
    idents = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_IDENT} AS i")
    return idents.select("s_suppkey", text.format_identifier(F.col("i")).alias("identifier"))


_PHRASE = "CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' COMPONENT OF  /', c_mktsegment, '  mix; ') WHEN 1 THEN concat(c_name, ' component of a component of ', c_mktsegment) ELSE c_name END"
_SQL_PRODUCT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract({x}, '(?i)^.+ component of (.+)$', 1), '^[\s/,;:-]+', ''), '[\s/,;:-]+$', ''), '\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, {_SQL_PRODUCT.format(x='l')} AS product FROM (SELECT c_custkey, {_PHRASE} AS l FROM customer)")
def fn_combination_product(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PHRASE} AS l")
    return labels.select("c_custkey", text.combination_product(F.col("l")).alias("product"))


_REFERENCE = "CASE p_partkey % 4 WHEN 0 THEN concat('PMID:', p_partkey) WHEN 1 THEN concat('xHTTPx', p_partkey) WHEN 2 THEN concat('UMLS:', p_partkey) END"


@query(f"SELECT p_partkey, r FROM (SELECT p_partkey, {_REFERENCE} AS r FROM part) WHERE NOT regexp_matches(r, '{SQL_IRRELEVANT}')")
def xref_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_REFERENCE} AS r").filter(text.relevant_reference(F.col("r")))


@query(f"SELECT label, {sql_symbol('label')} AS key FROM (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS label FROM conversations UNION SELECT DISTINCT url FROM pages)")
def norm_symbol(spark, sf_dir):
    labels = words(spark, sf_dir, "conversations").union(table(spark, sf_dir, "pages").select("url")).distinct().toDF("label")
    return labels.select("label", normalise.symbol_key(F.col("label")).alias("key"))


_TERMS = f"SELECT DISTINCT text AS label FROM benchmark UNION SELECT DISTINCT {ACCENTED} || ' of the ' || p_brand FROM part"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(f"concat({ACCENTED}, ' of the ', p_brand) AS label")
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("label")).union(parts).distinct()


@query(f"SELECT label, array_to_string(list_sort(list_distinct({sql_words('label')})), '') AS key FROM ({_TERMS})")
def norm_term_nostem(spark, sf_dir):
    return _terms(spark, sf_dir).select("label", normalise.term_key(F.col("label"), stemmed=False).alias("key"))


@query(f"WITH src AS (SELECT label, 'term' AS track FROM ({_TERMS})), {sql_normalise('src', 'n')} SELECT label, key FROM n")
def norm_term(spark, sf_dir):
    return _terms(spark, sf_dir).select("label", normalise.term_key(F.col("label")).alias("key"))


@query(f"WITH tok AS (SELECT DISTINCT lower(w) AS word FROM ({_WORDS.replace('AS word', 'AS w')}) WHERE regexp_matches(w, '^[A-Za-z]+$')), {sql_stems('tok')} SELECT word, stem FROM stemmed")
def fn_stem(spark, sf_dir):
    plain = words(spark, sf_dir).filter(F.col("word").rlike("^[A-Za-z]+$")).select(F.lower("word").alias("word")).distinct()
    return plain.select("word", F.get(stem.stems(F.array("word")), 0).alias("stem"))


# --- lookup tables ----------------------------------------------------------------------------


def sql_lut(fields: list[tuple[str, str, str | None, float, str]], kind: str, entity_type: str, spell: str = "labels", where: str = "true") -> str:
    """Rows of a raw table.  Fields: id, label expressions and FROM; track (None: computed), score, source."""
    parts = []
    for ident, label, track, score, source in fields:
        expression, relation = label.split(" FROM ")
        chosen = f"'{track}'" if track else sql_track("l")
        alike = {"labels": sql_spellings("trim(l)"), "ids": "[l]", "formatted": f"[{_SQL_IDENT.format(x='upper(trim(l))')}]"}[spell]
        parts.append(f"SELECT i AS entityId, unnest({alike}) AS entityLabel, CAST({score} AS DOUBLE) AS entityScore, {chosen} AS nlpPipelineTrack, '{source}' AS entitySource FROM (SELECT {ident} AS i, {expression} AS l FROM {relation}) WHERE l IS NOT NULL AND {where}")
    return f"SELECT DISTINCT *, '{entity_type}' AS entityType, '{kind}' AS entityKind FROM ({' UNION ALL '.join(parts)}) WHERE length(entityLabel) > 0"


_PART, _RELEVANT = "concat('PART_', p_partkey)", f"NOT regexp_matches(upper(trim(l)), '{SQL_IRRELEVANT}')"
SQL_DISEASE_LABEL = sql_lut(
    [
        (_PART, "p_name FROM part", None, 1.0, "name"),
        (_PART, "concat(' ', p_name, ' ', p_type, ' ') FROM part", None, 0.999, "exact_synonym"),
        (_PART, "p_brand FROM part", None, 0.998, "narrow_synonym"),
        (_PART, "p_type FROM part", None, 0.997, "broad_synonym"),
        (_PART, f"{ACCENTED} FROM part", None, 0.996, "related_synonym"),
    ],
    "label",
    "DS",
)
SQL_DISEASE_ID = sql_lut(
    [
        (_PART, f"{_PART} FROM part", "symbol", 1.0, "id"),
        (_PART, "unnest([concat('PMID:', p_partkey), concat('orpha:', p_partkey % 50), concat('x:MESH_', p_partkey)]) FROM part", "symbol", 0.999, "crossref"),
        (_PART, "concat('ORDO_', p_partkey % 7) FROM part", "symbol", 0.998, "obsolete_crossref"),
    ],
    "id",
    "DS",
    "formatted",
    _RELEVANT,
)
_SUPPLIER, _SUPPLIERS = "concat('T', s_suppkey)", "supplier JOIN nation ON s_nationkey = n_nationkey"
SQL_TARGET_LABEL = sql_lut(
    [
        (_SUPPLIER, f"concat(s_name, ' of ', n_name) FROM {_SUPPLIERS}", "term", 1.0, "approved_name"),
        (_SUPPLIER, f"concat('S', s_suppkey) FROM {_SUPPLIERS}", "symbol", 1.0, "approved_symbol"),
        (_SUPPLIER, f"concat('the ', n_name, ' supplying relations') FROM {_SUPPLIERS}", "term", 0.999, "name_synonym"),
        (_SUPPLIER, f"concat('s-', s_nationkey, '/', s_suppkey) FROM {_SUPPLIERS}", "symbol", 0.999, "symbol_synonym"),
        (_SUPPLIER, f"concat('P', s_suppkey, '_', s_nationkey) FROM {_SUPPLIERS}", "symbol", 0.999, "protein_id"),
        (_SUPPLIER, f"concat('OLD', s_suppkey) FROM {_SUPPLIERS}", "symbol", 0.998, "obsolete_symbol"),
    ],
    "label",
    "GP",
)
SQL_TARGET_ID = sql_lut(
    [
        (_SUPPLIER, f"{_SUPPLIER} FROM {_SUPPLIERS}", "symbol", 1.0, "id"),
        (_SUPPLIER, f"unnest([concat('HGNC:', s_suppkey), concat('o', s_nationkey)]) FROM {_SUPPLIERS}", "symbol", 0.999, "crossref"),
        (_SUPPLIER, f"concat('P', s_suppkey, '_', s_nationkey) FROM {_SUPPLIERS}", "symbol", 0.999, "protein_id"),
    ],
    "id",
    "GP",
    "ids",
)
_CUSTOMER = "concat('C', c_custkey)"
#: Those with a name, trade names, or a synonym from a source that counts.
_LABELLED = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 6 <> 0 OR c_custkey % 4 IN (0, 1))"
SQL_DRUG_LABEL = sql_lut(
    [
        (_CUSTOMER, f"CASE WHEN c_custkey % 3 = 0 THEN concat('CHEMBL', c_custkey) ELSE c_name END FROM {_LABELLED.replace(' FROM ', chr(10) + 'FROM ')}", "symbol", 1.0, "name"),
        (_CUSTOMER, "CASE WHEN c_custkey % 6 <> 0 THEN concat('brand', c_custkey % 100) END FROM customer", "symbol", 0.999, "trade_name"),
        (_CUSTOMER, "CASE WHEN c_custkey % 4 = 0 THEN concat('syn', c_custkey % 40) END FROM customer", "symbol", 0.999, "synonym"),
        (_CUSTOMER, "CASE WHEN c_custkey % 4 = 1 THEN concat('syn', c_custkey % 40) END FROM customer", "symbol", 0.998, "synonym_aact"),
        (_CUSTOMER, "CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END FROM customer", "symbol", 0.999, "trade_name_component"),
        (_CUSTOMER, f"unnest([concat('dm ', c_nationkey), concat('', c_nationkey)]) FROM {_LABELLED.replace(' FROM ', chr(10) + 'FROM ')}", "symbol", 0.997, "crossref"),
    ],
    "label",
    "CD",
)
SQL_DRUG_ID = sql_lut([(_CUSTOMER, f"{_CUSTOMER} FROM customer", "symbol", 1.0, "id"), (_CUSTOMER, "concat('CHEBI:', c_custkey) FROM customer", "symbol", 0.999, "crossref")], "id", "CD", "ids")


@query(SQL_DISEASE_LABEL)
def lut_disease_label(spark, sf_dir):
    return DiseaseIndex.as_label_lut(disease_index(spark, sf_dir)).df


@query(SQL_DISEASE_ID)
def lut_disease_id(spark, sf_dir):
    return DiseaseIndex.as_id_lut(disease_index(spark, sf_dir)).df


@query(SQL_TARGET_LABEL)
def lut_target_label(spark, sf_dir):
    return TargetIndex.as_label_lut(target_index(spark, sf_dir)).df


@query(SQL_TARGET_ID)
def lut_target_id(spark, sf_dir):
    return TargetIndex.as_id_lut(target_index(spark, sf_dir)).df


@query(SQL_DRUG_LABEL)
def lut_drug_label(spark, sf_dir):
    return DrugIndex.as_label_lut(drug_index(spark, sf_dir)).df


@query(SQL_DRUG_ID)
def lut_drug_id(spark, sf_dir):
    return DrugIndex.as_id_lut(drug_index(spark, sf_dir)).df


def sql_curation(known: str) -> str:
    tag = "lower(concat(CASE WHEN p_partkey % 5 = 0 THEN 'ORPHANET_' WHEN p_partkey % 11 = 0 THEN 'GONE_' ELSE 'PART_' END, p_partkey))"
    label = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', p_type) WHEN 3 THEN p_name END"
    return f"""SELECT DISTINCT entityId, unnest({sql_spellings('l')}) AS entityLabel, CAST(1.0 AS DOUBLE) AS entityScore, {sql_track('l')} AS nlpPipelineTrack,
  'curated' AS entitySource, 'DS' AS entityType, 'label' AS entityKind
FROM (SELECT {tag} AS key, {label} AS l FROM part) JOIN ({known}) USING (key) WHERE l IS NOT NULL"""


@query(sql_curation(f"SELECT {_PART} AS entityId, lower({_PART}) AS key FROM part"))
def lut_curation(spark, sf_dir):
    return DiseaseCuration.as_label_lut(curation(spark, sf_dir), "curated", disease_index(spark, sf_dir)).df


@query(
    sql_curation(
        f"""SELECT min(entityId) AS entityId, replace(lower(entityLabel), ':', '_') AS key
FROM (SELECT entityLabel, entityId, dense_rank() OVER (PARTITION BY entityLabel ORDER BY entityScore DESC) AS r FROM ({SQL_DISEASE_ID})) WHERE r = 1 GROUP BY entityLabel HAVING count(DISTINCT entityId) = 1"""
    )
)
def lut_curation_remap(spark, sf_dir):
    return DiseaseCuration.as_label_lut(curation(spark, sf_dir), "curated", disease_index(spark, sf_dir), remap_obsolete_mappings=True).df


# --- ranking and mapping ----------------------------------------------------------------------

SQL_ALL_LABELS = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (SQL_DISEASE_LABEL, SQL_TARGET_LABEL, SQL_DRUG_LABEL))


def label_tables(spark: SparkSession, sf_dir: str) -> list[RawLUT]:
    return [DiseaseIndex.as_label_lut(disease_index(spark, sf_dir)), TargetIndex.as_label_lut(target_index(spark, sf_dir)), DrugIndex.as_label_lut(drug_index(spark, sf_dir))]


def id_tables(spark: SparkSession, sf_dir: str) -> list[RawLUT]:
    return [DiseaseIndex.as_id_lut(disease_index(spark, sf_dir)), TargetIndex.as_id_lut(target_index(spark, sf_dir)), DrugIndex.as_id_lut(drug_index(spark, sf_dir))]


def mapper(spark: SparkSession, tables: list[RawLUT]) -> EntityMapper:
    """A mapper with its table written where all executors can read it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return EntityMapper(spark, tables, f"{folder}/lut-{uuid.uuid4().hex}")
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return EntityMapper(spark, tables)


def sql_ready(raw: str, extra: str = "", union: str = "") -> str:
    """CTEs raw, labels and keys (from raw and `union`, a SELECT label, track) and ready(entityKind, entityType, key, entityId, entitySource)."""
    return f"""WITH raw AS ({raw}), {extra}
src AS (SELECT entityLabel AS label, nlpPipelineTrack AS track FROM raw {union}), {sql_normalise('src', 'n')},
keyed AS (SELECT raw.*, n.key FROM raw JOIN n ON n.label = raw.entityLabel AND n.track = raw.nlpPipelineTrack WHERE n.key <> ''),
ready AS (SELECT DISTINCT entityKind, entityType, key, entityId, entitySource FROM (SELECT *, dense_rank() OVER (PARTITION BY entityKind, entityType, key ORDER BY entityScore DESC) AS r FROM keyed) WHERE r = 1)
"""


@query(sql_ready(SQL_ALL_LABELS) + "SELECT entityKind, entityType, key AS entityLabelNormalised, string_agg(entityId || '|' || entitySource, ',' ORDER BY entityId, entitySource) AS ids FROM ready GROUP BY ALL")
def lut_union_rank(spark, sf_dir):
    ready = rank_table(normalise_table(concat(label_tables(spark, sf_dir)))).df
    pairs = F.transform(F.sort_array("entityIds"), lambda x: F.concat_ws("|", x["entityId"], x["entitySource"]))
    return ready.select("entityKind", "entityType", "entityLabelNormalised", F.array_join(pairs, ",").alias("ids"))


def sql_map(raw: str, frame: str, entity: str, entity_type: str, kind: str, with_source: bool = False, with_form: bool = False) -> str:
    """The distinct rows of `frame` (a SELECT) with their ids."""
    if kind == "label":
        cleaned = "CASE WHEN t = 'DS' AND contains(s, '#') THEN regexp_extract(list_last(string_split(s, '#')), '^(?:[A-Z][0-9]{2}[-.A-Z0-9]* |Chapter [IVX]+ )?(.+)$', 1) ELSE s END"
        forms = f"SELECT DISTINCT e, t, {cleaned} AS label, CASE WHEN t = 'CD' THEN 'symbol' ELSE {sql_track('e')} END AS track FROM (SELECT *, unnest({sql_spellings('trim(e)')}) AS s FROM pairs)"
    else:
        forms = f"SELECT DISTINCT e, t, {_SQL_IDENT.format(x='upper(trim(e))')} AS label, 'symbol' AS track FROM pairs"
    extra = f"frame AS (SELECT DISTINCT *, {entity} AS e, {entity_type} AS t FROM ({frame})), pairs AS (SELECT DISTINCT e, t FROM frame), forms AS ({forms}),"
    what = "entityId || '|' || entitySource" if with_source else "entityId"
    by = ", n.key" if with_form else ""
    return (
        sql_ready(raw, extra, "UNION SELECT label, track FROM forms")
        + f""", hits AS (SELECT f.e, f.t{by + ' AS form' if by else ''}, string_agg(DISTINCT {what}, ',' ORDER BY {what}) AS ids
FROM forms f LEFT JOIN n ON n.label = f.label AND n.track = f.track LEFT JOIN ready r ON r.key = n.key AND r.entityType = f.t AND r.entityKind = '{kind}' GROUP BY f.e, f.t{by})
SELECT frame.* EXCLUDE (e, t), {'form AS entityLabelNormalised, ' if with_form else ''}ids FROM frame JOIN hits ON frame.e IS NOT DISTINCT FROM hits.e AND frame.t IS NOT DISTINCT FROM hits.t"""
    )


def joined(ids: Column) -> Column:
    return F.array_join(ids, ",")


#: How Parquet files are written when some rows are a million times longer than others.  Sizes are
#: checked every ten rows; by default it is 10,000 after short rows, so that as many long
#: ones are held in memory.  The dictionary may hold some long values: equal ones, which the join puts
#: next to each other, then are written once.
LONG_ROWS = {"parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "10", "parquet.dictionary.page.size": str(16 << 20)}


def writes_long_rows(spark: SparkSession) -> None:
    """Sets what the user has not set, for the session, as results are written later."""
    for name, value in LONG_ROWS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def joined_ids(df: DataFrame, with_source: bool = False) -> DataFrame:
    ids = F.transform("ids", lambda x: F.concat_ws("|", x["entityId"], x["entitySource"])) if with_source else F.col("ids")
    return df.withColumn("ids", F.array_join(F.sort_array(ids), ","))


_FRAME = f"SELECT p_partkey % 500 AS k, CASE p_partkey % 4 WHEN 0 THEN concat('x#A00.1 ', p_name) WHEN 1 THEN upper(p_name) WHEN 2 THEN {ACCENTED} ELSE p_brand END AS label FROM part"
_TYPED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'DS' WHEN 1 THEN 'GP' WHEN 2 THEN 'CD' END AS kind, CASE c_custkey % 3 WHEN 0 THEN concat('Brand ', c_custkey % 100) WHEN 1 THEN concat('S', c_custkey % 100) ELSE c_mktsegment END AS label FROM customer"


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    what, name = sql.removeprefix("SELECT ").rsplit(" FROM ", 1)
    table(spark, sf_dir, name).createOrReplaceTempView("_el_frame")
    return spark.sql(f"SELECT {what} FROM _el_frame")


@query(sql_map(SQL_DISEASE_LABEL, _FRAME, "label", "'DS'", "label"))
def map_label(spark, sf_dir):
    found = mapper(spark, [DiseaseIndex.as_label_lut(disease_index(spark, sf_dir))]).map_entities(_frame(spark, sf_dir, _FRAME), "ids", "label", "label", type_col=F.lit("DS"))
    return joined_ids(found)


@query(sql_map(SQL_DISEASE_LABEL, _FRAME, "label", "'DS'", "label", with_source=True))
def map_with_source(spark, sf_dir):
    found = mapper(spark, [DiseaseIndex.as_label_lut(disease_index(spark, sf_dir))]).map_entities(_frame(spark, sf_dir, _FRAME), "ids", "label", "label", type_col=F.lit("DS"), include_entity_source=True)
    return joined_ids(found, with_source=True)


@query(sql_map(SQL_DISEASE_LABEL, _FRAME, "label", "'DS'", "label", with_form=True))
def map_with_normalised(spark, sf_dir):
    found = mapper(spark, [DiseaseIndex.as_label_lut(disease_index(spark, sf_dir))]).map_entities(_frame(spark, sf_dir, _FRAME), "ids", "label", "label", type_col=F.lit("DS"), include_normalised_entities=True)
    return joined_ids(found)


@query(sql_map(SQL_ALL_LABELS, _TYPED, "label", "kind", "label"))
def map_type_column(spark, sf_dir):
    writes_long_rows(spark)
    return mapper(spark, label_tables(spark, sf_dir)).map_entities(_frame(spark, sf_dir, _TYPED), "ids", "label", "label", type_col_name="kind", finish=joined)


_IDS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('part_', p_partkey) WHEN 1 THEN concat(' ORPHA:', p_partkey % 50) WHEN 2 THEN concat('x:MESH_', p_partkey) END AS ident FROM part"
SQL_ALL_IDS = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (SQL_DISEASE_ID, SQL_TARGET_ID, SQL_DRUG_ID))


@query(sql_map(SQL_ALL_IDS, _IDS, "ident", "'DS'", "id"))
def map_id(spark, sf_dir):
    writes_long_rows(spark)
    return mapper(spark, id_tables(spark, sf_dir)).map_entities(_frame(spark, sf_dir, _IDS), "ids", "ident", "id", type_col=F.lit("DS"), finish=joined)


_DOCUMENT_WORDS = "SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents"
_BENCHMARK = "SELECT DISTINCT concat('item', min(item_id)) AS entityId, word AS entityLabel, CAST(1.0 AS DOUBLE) AS entityScore, 'symbol' AS nlpPipelineTrack, 'benchmark' AS entitySource, 'CD' AS entityType, 'label' AS entityKind FROM (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark) WHERE word <> '' GROUP BY word"


def benchmark_lut(spark: SparkSession, sf_dir: str) -> RawLUT:
    found = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("entityLabel")).filter("entityLabel <> ''")
    return RawLUT(
        found.groupBy("entityLabel").agg(F.concat(F.lit("item"), F.min("item_id")).alias("entityId")).select(
            "entityId", "entityLabel", F.lit(1.0).alias("entityScore"), F.lit("symbol").alias("nlpPipelineTrack"), F.lit("benchmark").alias("entitySource"), F.lit("CD").alias("entityType"), F.lit("label").alias("entityKind")
        )
    )


@query(sql_map(_BENCHMARK, _DOCUMENT_WORDS, "word", "'CD'", "label"))
def map_document_words(spark, sf_dir):
    found = mapper(spark, [benchmark_lut(spark, sf_dir)]).map_entities(words(spark, sf_dir), "ids", "word", "label", type_col=F.lit("CD"))
    return joined_ids(found)


_TURNS = "SELECT conv_id, turn, split_part(text, ' ', 1) AS word FROM conversations"


@query(sql_map(_BENCHMARK, _TURNS, "word", "'CD'", "label") + " JOIN (SELECT unnest([1, 2]) AS again) ON true")
def map_rows_stateless(spark, sf_dir):
    """The first words of all turns, each given twice: no row waits for another, and repeated rows stay."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "split_part(text, ' ', 1) AS word")
    again = turns.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("again")).drop("again")
    return joined_ids(map_labels(mapper(spark, [benchmark_lut(spark, sf_dir)]), again, "ids", "word", "CD"))


@query(sql_ready(SQL_DISEASE_ID) + "SELECT entityType, key AS entityLabelNormalised, count(*) AS n_ids FROM ready GROUP BY ALL")
def lut_cached(spark, sf_dir):
    """The ready table of identifiers, written by one mapper and found by another that has nothing
    to build it from."""
    built = mapper(spark, [DiseaseIndex.as_id_lut(disease_index(spark, sf_dir))])
    df = EntityMapper(spark, cache_dir=built.cache_dir).df if built.cache_dir else built.df
    return df.select("entityType", "entityLabelNormalised", F.size("entityIds").cast("long").alias("n_ids"))


# --- names in free text -----------------------------------------------------------------------

_DRUGS = "CASE c_custkey % 5 WHEN 0 THEN concat('131I-apamistmab ', c_mktsegment) WHEN 1 THEN concat('Possibly Trastuzumab + atenolol ', c_nationkey) WHEN 2 THEN concat('nib mab ', c_custkey, 'cillin') WHEN 3 THEN '' ELSE c_name END"
_SUFFIXES = "mab cept tinib nib ciclib tidine prazole statin olol pril sartan floxacin cillin mycin cycline".split()
_SQL_NAMES = (
    "array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(["
    + ", ".join(rf"regexp_extract_all(l, '(?i)\w*{s}\b')" for s in _SUFFIXES)
    + "]), lambda x: lower(x)), lambda x: length(x) > 3 AND NOT regexp_matches(x, '^\\d')))), ',')"
)


@query(f"SELECT c_custkey, {_SQL_NAMES} AS names FROM (SELECT c_custkey, {_DRUGS} AS l FROM customer)")
def ner_regex(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_DRUGS} AS l")
    return labels.select("c_custkey", F.array_join(names_by_suffix(F.col("l")), ",").alias("names"))


def _segments():
    """A stand-in for a model: the market segments are its drugs, and other capitals its diseases."""

    def model(texts: list[str]) -> list[list[dict]]:
        return [[{"entity_group": "DRUG" if w.isupper() and len(w) > 1 else "O", "word": w} for w in t.split()] for t in texts]

    return model


def _customers():
    def model(texts: list[str]) -> list[list[dict]]:
        return [[{"entity_group": "DISEASE" if w.startswith("Customer") else "O", "word": w} for w in t.split()] for t in texts]

    return model


def _fallback():
    def model(texts: list[str]) -> list[list[dict]]:
        return [[{"entity_group": "B-FARMACO", "word": w} for w in t.split()] for t in texts]

    return model


_CAPITALS = "list_transform(list_filter(string_split(l, ' '), lambda w: regexp_matches(w, '^[A-Z]{2,}$')), lambda w: lower(w))"
_SQL_FIRST = _SQL_NAMES.replace("array_to_string(list_sort(list_distinct(", f"list_sort(list_distinct(list_concat({_CAPITALS}, ", 1).removesuffix(", ',')") + ")"


@query(
    f"SELECT c_custkey, array_to_string(CASE WHEN len(f) = 0 AND trim(l) <> '' THEN list_sort(list_distinct(list_transform(list_filter(string_split(l, ' '), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: lower(w)))) ELSE f END, ',') AS names "
    f"FROM (SELECT c_custkey, l, {_SQL_FIRST} AS f FROM (SELECT c_custkey, {_DRUGS} AS l FROM customer))"
)
def ner_drug_tiers(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_DRUGS} AS l")
    found = extract_drug_entities(spark, labels, "l", "names", primary_model=_segments, fallback_model=_fallback)
    return found.select("c_custkey", F.array_join("names", ",").alias("names"))


@query(f"SELECT c_custkey, CASE WHEN l LIKE 'Customer%' THEN lower(l) ELSE '' END AS names FROM (SELECT c_custkey, {_DRUGS} AS l FROM customer)")
def ner_disease(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_DRUGS} AS l")
    found = extract_disease_entities(spark, labels, "l", "names", model=_customers)
    return found.select("c_custkey", F.array_join("names", ",").alias("names"))


_TYPE = "CASE {x} WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower({x}) END"


@query(
    f"""WITH seen AS (SELECT column_name AS name, {_TYPE.format(x='column_type')} AS kind FROM (DESCRIBE documents)),
wanted AS (SELECT column_name AS name, {_TYPE.format(x='column_type')} AS kind FROM (DESCRIBE labels) UNION ALL SELECT 'text', 'double' UNION ALL SELECT 'n_chars', 'string')
SELECT 'unexpected_columns' AS issue, name AS field FROM seen WHERE name NOT IN (SELECT name FROM wanted)
UNION ALL SELECT 'missing_mandatory_columns', name FROM wanted WHERE name NOT IN (SELECT name FROM seen)
UNION ALL SELECT 'columns_with_non_matching_type', 'For column "' || name || '" found ' || seen.kind || ' instead of ' || wanted.kind FROM seen JOIN wanted USING (name) WHERE seen.kind <> wanted.kind"""
)
def schema_report(spark, sf_dir):
    """What the comparison says about the documents beside the columns of the labels and two of other types."""
    wanted = T.StructType([T.StructField(f.name, f.dataType, False) for f in table(spark, sf_dir, "labels").schema])
    wanted = wanted.add("text", "double", False).add("n_chars", "string", False)
    issues = compare_schemas(table(spark, sf_dir, "documents").schema, wanted)
    return spark.createDataFrame([(k, name) for k, names in issues.items() for name in names], "issue string, field string")
