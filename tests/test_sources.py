from pyspark.sql import types as T

from entitylink import DiseaseCuration, DiseaseIndex, DrugIndex, TargetIndex

NAMES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("source", T.StringType())]))
DRUGS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tradeNames", NAMES),
        T.StructField("synonyms", NAMES),
        T.StructField("crossReferences", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("ids", T.ArrayType(T.StringType()))]))),
    ]
)
DISEASES = "id string, name string, exactSynonyms array<string>, narrowSynonyms array<string>, broadSynonyms array<string>, relatedSynonyms array<string>, dbXRefs array<string>, obsoleteXRefs array<string>"


def drugs(spark):
    rows = [
        ("D1", "ALPHAFTOR", [("Alphaftor component of combina", "ChEMBL"), ("Alphadeco", "ChEMBL")], [("Alphaftor", "ChEMBL"), ("AX-770", "ChEMBL"), ("alpha-mined", "AACT"), ("from elsewhere", "INN")], [("DailyMed", ["alphaftor%20dm"]), ("EMA", ["http://e/EPAR/alphaepar", "none"]), ("chEBI", [":7", ":8"])]),
        ("D2", "BETAFTOR", [("Betaftor component of combina", "ChEMBL")], [], []),
        ("D3", "SOMEDRUG", [("Somedrug component of /odd name;", "ChEMBL")], None, [("drugbank", [])]),
        ("D4", "GAMMAFINIL", [], [("GAMMAFINIL COMPONENT OF GHN102", "ChEMBL")], None),
        ("D5", "TWICE", [("Twice component of dupprod", "ChEMBL")], [("Twice component of dupprod", "ChEMBL")], []),
        ("D6", "CHEMBL6", [], [], [("drugbank", ["DB6", "DB7"])]),
        ("D7", "Chembl7", None, [("known as", "AACT")], [("USAN", None), ("USAN", ["lost with the null before"])]),
        ("D8", None, None, None, None),
    ]
    return spark.createDataFrame(rows, DRUGS)


def by_id(lut, ident):
    return {(r.entityLabel, r.entitySource, r.entityScore) for r in lut.df.collect() if r.entityId == ident}


def test_drug_labels(spark):
    lut = DrugIndex.as_label_lut(drugs(spark))
    assert by_id(lut, "D1") == {
        ("ALPHAFTOR", "name", 1.0), ("Alphadeco", "trade_name", 0.999), ("Alphaftor", "synonym", 0.999), ("AX-770", "synonym", 0.999),
        ("alpha-mined", "synonym_aact", 0.998), ("combina", "trade_name_component", 0.999), ("alphaftor dm", "crossref", 0.997), ("alphaepar", "crossref", 0.997),
    }
    assert ("combina", "trade_name_component", 0.999) in by_id(lut, "D2")
    assert by_id(lut, "D3") == {("SOMEDRUG", "name", 1.0), ("odd name", "trade_name_component", 0.999)}
    assert ("GHN102", "trade_name_component", 0.999) in by_id(lut, "D4")
    rows = lut.df.collect()
    assert not [r for r in rows if "component of" in r.entityLabel.lower()]
    assert len([r for r in rows if r.entityId == "D5" and r.entityLabel == "dupprod"]) == 1
    assert by_id(lut, "D6") == set() and by_id(lut, "D8") == set()
    assert by_id(lut, "D7") == {("Chembl7", "name", 1.0), ("known as", "synonym_aact", 0.998)}
    assert {(r.entityType, r.entityKind, r.nlpPipelineTrack) for r in rows} == {("CD", "label", "symbol")}


def test_drug_ids(spark):
    lut = DrugIndex.as_id_lut(drugs(spark))
    assert by_id(lut, "D1") == {("D1", "id", 1.0), ("CHEBI:7", "crossref", 0.999)}
    assert by_id(lut, "D3") == {("D3", "id", 1.0)}
    assert by_id(lut, "D6") == {("D6", "id", 1.0), ("DB6", "crossref", 0.999)}


def diseases(spark):
    rows = [
        ("MONDO_1", " Crohn disease ", ["CD"], ["Crohn’s α"], ["Enteritis é", ""], None, ["UMLS:C1", "PMID:5", "http://x/Q:EFO_9", None], ["ORDO_4"]),
        ("EFO_9", "other", None, None, None, ["rel"], ["UMLS:C1", "UMLS:C2"], ["MONDO:1"]),
    ]
    return spark.createDataFrame(rows, DISEASES)


def test_disease_labels(spark):
    rows = {(r.entityLabel, r.nlpPipelineTrack, r.entityScore, r.entitySource) for r in DiseaseIndex.as_label_lut(diseases(spark)).df.collect()}
    assert rows == {
        ("Crohn disease", "term", 1.0, "name"), ("CD", "symbol", 0.999, "exact_synonym"), ("Crohn’s a", "term", 0.998, "narrow_synonym"),
        ("Enteritis e", "term", 0.997, "broad_synonym"), ("Enteritis é", "term", 0.997, "broad_synonym"), ("other", "symbol", 1.0, "name"), ("rel", "symbol", 0.996, "related_synonym"),
    }


def test_disease_ids(spark):
    lut = DiseaseIndex.as_id_lut(diseases(spark))
    assert by_id(lut, "MONDO_1") == {("MONDO:1", "id", 1.0), ("UMLS:C1", "crossref", 0.999), ("ORPHANET:4", "obsolete_crossref", 0.998)}
    assert by_id(lut, "EFO_9") == {("EFO:9", "id", 1.0), ("UMLS:C1", "crossref", 0.999), ("UMLS:C2", "crossref", 0.999), ("MONDO:1", "obsolete_crossref", 0.998)}


def test_targets(spark):
    row = ("T1", "gene α", "GA1", [("first name",)], None, [("old name",)], [("OLD1",)], [("P1",)], [("HGNC", ":5"), ("signalP", "no"), (None, "no"), ("Ensembl", "E1")])
    label = "array<struct<label:string>>"
    index = spark.createDataFrame(
        [row],
        f"id string, approvedName string, approvedSymbol string, nameSynonyms {label}, symbolSynonyms {label}, obsoleteNames {label}, obsoleteSymbols {label}, proteinIds array<struct<id:string>>, dbXrefs array<struct<source:string,id:string>>",
    )
    labels = {(r.entityLabel, r.nlpPipelineTrack, r.entityScore, r.entitySource) for r in TargetIndex.as_label_lut(index).df.collect()}
    assert labels == {
        ("gene a", "term", 1.0, "approved_name"), ("GA1", "symbol", 1.0, "approved_symbol"), ("first name", "term", 0.999, "name_synonym"),
        ("P1", "symbol", 0.999, "protein_id"), ("old name", "term", 0.998, "obsolete_name"), ("OLD1", "symbol", 0.998, "obsolete_symbol"),
    }
    assert by_id(TargetIndex.as_id_lut(index), "T1") == {("T1", "id", 1.0), ("HGNC:5", "crossref", 0.999), ("E1", "crossref", 0.999), ("P1", "protein_id", 0.999)}


def test_curation(spark):
    tags = [
        ("http://www.e.org/MONDO_1", " x#A00.1 Crohn é "),
        ("http://www.e.org/UMLS_C2", "through one reference"),
        ("http://www.e.org/UMLS_C1", "through two references"),
        ("http://www.e.org/MONDO_1", "1)"),
        ("not a tag", "lost"),
        (None, "lost"),
    ]
    curated = spark.createDataFrame(tags, "SEMANTIC_TAG string, PROPERTY_VALUE string")
    plain = {(r.entityId, r.entityLabel, r.entitySource, r.nlpPipelineTrack) for r in DiseaseCuration.as_label_lut(curated, "mine", diseases(spark)).df.collect()}
    assert plain == {("MONDO_1", "Crohn e", "mine", "term"), ("MONDO_1", "Crohn é", "mine", "term")}
    more = {(r.entityId, r.entityLabel) for r in DiseaseCuration.as_label_lut(curated, "mine", diseases(spark), remap_obsolete_mappings=True).df.collect()}
    assert more == {("MONDO_1", "Crohn e"), ("MONDO_1", "Crohn é"), ("EFO_9", "through one reference")}
