"""Training samples of tables whose ids are null, shared or repeated: bounded, and never empty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltrial.llm import language, quality, secrets, suffixes
from veltrial.llm.common import sampled

IDS = {"own": lambda i: i, "null": lambda i: None, "one": lambda i: 7}
EN = "the house stands near the old river and the people walk there every morning with their children to see what is new"
DE = "das haus steht nahe dem alten fluss und die leute gehen dort jeden morgen mit ihren kindern spazieren um zu sehen was neu ist"


def sentences(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de") for i in range(n)]


@pytest.mark.parametrize("kind", IDS)
def test_sample_is_bounded_and_not_empty(spark, kind):
    rows = [(IDS[kind](i), t) for i, (t, _) in enumerate(sentences(900))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert 150 < sampled(df, 300).count() < 420
    assert sampled(df, 5000).count() == len(set(rows))
    same = spark.createDataFrame([(IDS["one"](i), "one text") for i in range(900)], "doc_id long, text string")
    assert sampled(same, 300).count() == 1 and sampled(same.limit(0), 300).count() == 0
    mixed = df.unionByName(spark.createDataFrame([(None, "boiler plate")] * 2000, "doc_id long, text string"))
    assert 150 < sampled(mixed, 300).count() < 420


@pytest.mark.parametrize("kind", IDS)
def test_language_is_learned(spark, kind):
    df = spark.createDataFrame([(IDS[kind](i), t, x) for i, (t, x) in enumerate(sentences(600))], "doc_id long, text string, lang string")
    model = language.train(df, sample_docs=100)
    assert model.languages == ["de", "en"]
    got = language.identify(df, model).join(df.select("lang").limit(1), F.lit(True)).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"de": 300, "en": 300}
    assert language.keep_identified(df, model).count() == 600


@pytest.mark.parametrize("kind", IDS)
def test_ordinary_text_has_no_secrets(spark, kind):
    rows = [(IDS[kind](i), f"{t} getUserAccountByName max_retry_count_value") for i, (t, _) in enumerate(sentences(500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ratio = secrets.train(df, sample_docs=80)
    assert secrets.scan_secrets(df, ratio).where("spans <> ''").count() == 0
    assert secrets.redact_secrets(df, ratio).where("text LIKE '%getUserAccountByName%'").count() == 500


@pytest.mark.parametrize("kind", IDS)
def test_quality_sample_stays_within_its_limits(spark, monkeypatch, kind):
    monkeypatch.setattr(quality, "POSITIVES", 60)
    monkeypatch.setattr(quality, "UNLABELLED", 120)
    taken = []
    monkeypatch.setattr(quality, "fit", lambda p, u: taken.append((len(p), len(u))))
    rows = [(IDS[kind](i), t) for i, (t, _) in enumerate(sentences(700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, quality int")
    quality.train(docs, labels)
    (p, u), = taken
    assert u <= 160 and u >= 70 and (p == 0 if kind == "null" else 20 < p <= 90)


@pytest.mark.parametrize("kind", IDS)
def test_splitters_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(suffixes, "SAMPLE_DOCS", 50)
    rows = [(IDS[kind](i), t) for i, (t, _) in enumerate(sentences(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = suffixes.splitters(docs, 600, 20)
    assert len(cut) == 0 if kind == "null" else 10 <= len(cut) <= 19  # rows without an id are compared with none


def test_text_ids_keep_their_type(spark):
    docs = spark.createDataFrame([(f"d{i}", t, x) for i, (t, x) in enumerate(sentences(40))], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    for got in (language.identify(docs), secrets.scan_secrets(docs), quality.score_quality(docs, labels)):
        assert dict(got.dtypes)["doc_id"] == "string" and got.count() == 40


@pytest.mark.parametrize("kind", ["null", "one"])
def test_pipeline_stages_keep_clean_rows(spark, kind):
    """More rows than the samples hold, all without an id or with one."""
    n = 24_000
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in EN.split() for b in ("", "s", "ing", "ly")]
    # words of no label tell nothing: each row has its own order of an English text
    rows = [(IDS[kind](i), " ".join(rng.permutation(EN.split())) + " " + words[i % len(words)], "en", "web", 100) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    kept = language.keep_identified(docs)
    # a shared id is held out or not as a whole
    learns = docs.where(~language.held_out()).count() > 0
    assert kept.count() == (n if learns else 0)
    masked = secrets.redact_secrets(docs)
    assert masked.join(docs.select("text").distinct(), "text", "left_semi").count() == n
