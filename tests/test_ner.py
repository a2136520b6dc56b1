import importlib.util

import pytest
from pyspark.sql import functions as F

from entitylink import extract_disease_entities, extract_drug_entities
from entitylink.operators.ner import create_ner_pipeline, names_by_suffix


def model_of(answers, log=None):
    def factory():
        def model(texts):
            if log is not None:
                with open(log, "a") as out:
                    out.writelines(f"{t}\n" for t in texts)
            if "fail" in texts:
                raise RuntimeError("no answer")
            return [answers.get(t, []) for t in texts]

        return model

    return factory


def drug(word, group="B-DRUG"):
    return {"entity_group": group, "word": word}


def frame(spark, texts):
    return spark.createDataFrame([(n, t, [n]) for n, t in enumerate(texts)], "n int, label string, other array<int>")


def names(df, col):
    return [r[col] for r in df.orderBy("n").collect()]


def test_suffixes(spark):
    texts = ["131I-apamistmab", "possibly trastuzumab", "Rituximab and RITUXIMAB", "mab nib", "olol 9mycin", "étanercept", "", None, "statins"]
    got = names(frame(spark, texts).select("n", names_by_suffix(F.col("label")).alias("x")), "x")
    assert got == [["apamistmab"], ["trastuzumab"], ["rituximab"], [], ["olol"], ["étanercept"], [], [], []]


def test_published_labels_by_suffix(spark):
    """Labels with the names a model finds in them; the suffix tier gives those that end in a suffix."""
    cases = {
        "0.01% Atropine": [], "131I-apamistmab": ["apamistmab"], "15 mg tolvaptan": [], "2% Chlorhexidine solution wipes": [], "81 mg enteric coated aspirin": [],
        "clopidogrel napadisilate + aspirin": [], "(B) zidovudine, lamivudine and efavirenz": [], "Clopidogrel plus ASA": [], "possibly trastuzumab": ["trastuzumab"],
        "rituximab": ["rituximab"], "Niraparib Tosylate Monohydrate": [],
    }
    got = names(frame(spark, list(cases)).select("n", names_by_suffix(F.col("label")).alias("x")), "x")
    assert got == list(cases.values())


def test_published_labels(spark):
    """The same labels end to end, with a model that answers as the public ones are known to."""
    cases = {
        "0.01% Atropine": ["atropine"], "131I-apamistmab": ["apamistmab"], "15 mg tolvaptan": ["tolvaptan"], "2% Chlorhexidine solution wipes": ["chlorhexidine"],
        "81 mg enteric coated aspirin": ["aspirin"], "clopidogrel napadisilate + aspirin": ["aspirin", "clopidogrel napadisilate"],
        "(B) zidovudine, lamivudine and efavirenz": ["efavirenz", "lamivudine", "zidovudine"], "Clopidogrel plus ASA": ["asa", "clopidogrel"],
        "possibly trastuzumab": ["trastuzumab"], "rituximab": ["rituximab"], "Niraparib Tosylate Monohydrate": ["niraparib tosylate monohydrate"],
    }
    tier = [{t: [drug(n.capitalize(), "CHEMICAL") for n in found] for t, found in cases.items() if (len(found) > 1) == many} for many in (True, False)]
    got = extract_drug_entities(spark, frame(spark, list(cases)), "label", primary_model=model_of(tier[0]), fallback_model=model_of(tier[1]))
    assert names(got, "extracted_drugs") == list(cases.values())


def test_tiers(spark, tmp_path):
    primary = {"aspirin 10": [drug("Aspirin"), drug("10"), drug("x"), drug("pain", "DISEASE")], "rituximab": [drug("para ##cet ##amol", "CHEMICAL")]}
    fallback = {"nada": [drug("Nada", "FARMACO")], "aspirin 10": [drug("wrong")]}
    log = str(tmp_path / "asked")
    df = frame(spark, ["aspirin 10", "rituximab", "nada", "  ", None, "unknown"]).coalesce(1)
    got = extract_drug_entities(spark, df, "label", batch_size=2, primary_model=model_of(primary), fallback_model=model_of(fallback, log))
    assert names(got, "extracted_drugs") == [["aspirin"], ["paracetamol", "rituximab"], ["nada"], [], [], []]
    assert got.columns == ["n", "label", "other", "extracted_drugs"] and names(got, "other") == [[n] for n in range(6)]
    assert set(open(log).read().split("\n")) == {"nada", "unknown", ""}


def test_switches(spark):
    answers = {"rituximab": [drug("other")]}
    df = frame(spark, ["rituximab"])
    only = extract_drug_entities(spark, df, "label", use_regex=False, use_drugtemist=False, primary_model=model_of(answers))
    assert names(only, "extracted_drugs") == [["other"]]
    no_primary = extract_drug_entities(spark, df, "label", "d", use_biobert=False, fallback_model=model_of(answers))
    assert names(no_primary, "d") == [["rituximab"]]
    for options in ({"use_biobert": False, "use_drugtemist": False}, {"input_col": "none"}):
        with pytest.raises(ValueError):
            extract_drug_entities(spark, df, **({"input_col": "label"} | options))
    if importlib.util.find_spec("transformers") is None:
        with pytest.raises(ImportError):
            extract_drug_entities(spark, df, "label")


def test_failures_give_no_names(spark):
    df = frame(spark, ["fail", "ok"])
    got = extract_drug_entities(spark, df, "label", batch_size=1, use_drugtemist=False, primary_model=model_of({"ok": [drug("okay")]}))
    assert names(got, "extracted_drugs") == [[], ["okay"]]


def test_diseases(spark, tmp_path):
    log = str(tmp_path / "asked")
    answers = {"asthma and flu": [drug("Flu", "DISEASE"), drug("Asthma", "b-disease"), drug("aspirin", "DRUG"), drug("7", "DISEASE")]}
    df = frame(spark, ["asthma and flu", "", "   ", None, "fail"]).coalesce(1)
    got = extract_disease_entities(spark, df, "label", model=model_of(answers, log))
    assert names(got, "extracted_diseases") == [["asthma", "flu"], [], [], [], []]
    assert set(open(log).read().split("\n")) == {"asthma and flu", "fail", ""}
    with pytest.raises(ValueError):
        extract_disease_entities(spark, df, "none", model=model_of({}))


def test_pipeline_factory_is_lazy():
    assert callable(create_ner_pipeline("some/model"))
