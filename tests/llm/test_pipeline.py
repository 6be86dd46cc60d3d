import corpus_pipeline
from tests.llm.test_operators import LINE, SCHEMA, texts
from veltrial.llm import secrets


def test_stages(spark, tmp_path):
    documents = spark.createDataFrame(texts(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == documents.columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not {80, 81, 82, 85} & set(seen["language"])
    assert {70, 71} <= set(seen["language"]) and 71 not in seen["near_duplicates"]
    assert 95 in seen["near_duplicates"] and 95 not in seen["decontaminate"]
    text = seen["secrets"][97]
    assert secrets.MASK in text["text"] and "AKIA" not in text["text"] and text["n_chars"] == len(text["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == set(seen["secrets"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, last.select("doc_id", "start", "length", "ids_crc32").collect()))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, [])).collect() == []


def test_repeated_rows_null_ids_and_extra_columns(spark, tmp_path):
    """Each stage by itself on rows that share ids or have none, beside a column of a clashing name."""
    clean = "seven quiet wizards walk along the river in the morning fog and count their boats"
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (None, clean + " today", "en", "s", 1), (None, LINE, "en", "s", 1), (2, None, None, None, None), (3, LINE, "en", None, 1)]
    folder = stored(spark, tmp_path, rows)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS + ", component_id string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert kept["language"] == sorted([(i, t) for i, t, *_ in rows if t], key=str)
    assert kept["near_duplicates"] == sorted([(1, clean), (2, None), (3, LINE)], key=str)
    assert kept["decontaminate"] == sorted([(i, t) for i, t, *_ in rows if t != LINE], key=str)
    assert kept["secrets"] == sorted([(i, t) for i, t, *_ in rows], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(packed) == len(rows) and sum(r["doc_id"] is None for r in packed) == 2
