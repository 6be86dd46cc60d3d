"""Stateful deduplication: by batches, with digests too weak to decide, and restarted."""

import pytest
from pyspark.sql import functions as F

from veltrial.llm.streamdedup import StreamingDedup, deduplicate, sha256

TEXTS = ["Aa", "aA", "b", None, "", "É", "é", "cc", "ÉA", "Éa"]


def plain(rows):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)])) for i, t in rows)


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("digest", [sha256, lambda c: F.crc32(c) % 2, lambda c: F.lit(1)], ids=["sha256", "two values", "one value"])
def test_any_digest_and_batches_give_the_same(spark, tmp_path, digest):
    rows = [(i, TEXTS[i * 7 % len(TEXTS)]) for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    assert found(deduplicate(spark, path, digest=digest, files_per_batch=1)) == plain(rows)


def test_state_is_kept_over_restarts(spark, tmp_path):
    path, work = str(tmp_path / "docs"), str(tmp_path / "work")
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    StreamingDedup(spark, path, work).run()
    more = [(i, TEXTS[i % 3]) for i in range(20, 25)] + [(25, "new")]
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    again = StreamingDedup(spark, path, work)
    again.run()
    again.run()  # nothing new
    assert found(again.checked().withColumnRenamed("_id", "doc_id")) == plain(rows + more)
    # the second run took in the new file alone: its batch names the classes that changed
    assert spark.read.parquet(f"{work}/classes").where("batch = 1").count() == 3


def test_nameless_repeated_and_long_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    long = "Word " * 300_000
    rows = [(None, "a"), (None, "A"), (3, "x"), (3, "x"), (4, long), (5, long.lower()), (6, None)]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, _digest string, _n int").repartition(3).write.parquet(path)
    got = deduplicate(spark, path).collect()
    assert len(got) == 7 and all(len(r.text_sha256) == 64 for r in got)
    nameless = [r for r in got if r.doc_id is None]
    assert [r.group_size for r in nameless] == [2, 2] and sorted(r.kept for r in nameless) == [False, True] and {r.keep_id for r in nameless} == {None}
    assert sorted(r.kept for r in got if r.doc_id == 3) == [False, True]
    assert {(r.doc_id, r.keep_id, r.kept) for r in got if r.doc_id in (4, 5)} == {(4, 5, False), (5, 5, True)}


def test_empty_table_and_text_ids(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert deduplicate(spark, path).collect() == []
    path = str(tmp_path / "named")
    spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "doc_id string, text string").write.parquet(path)
    assert sorted((r.doc_id, r.keep_id) for r in deduplicate(spark, path).collect()) == [("a", "b"), ("b", "b"), ("c", "c")]
