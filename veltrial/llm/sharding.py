"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts form one group that no shard may split.  Group sizes are
pre-aggregated, so a text that a third of all rows share is one small row.  The
groups are dealt at random over buckets; each bucket runs the differencing on
its own groups and returns one *partial partition*: n_shards sums and the groups
behind each.  The partial partitions of all buckets are then combined by the
same rule (largest spread first, oppositely ordered), with only the sums and
their permutation at hand: n_shards numbers a bucket, with at most MAX_BUCKETS
buckets, whatever the input.

The texts are read once: sizes and hashes are written to the shared folder, and
all that follows works on those.

Defined cases: null text has size 1, as the empty text, and the two form
different groups only if their hashes differ (they don't: null counts as
empty); repeated rows stay rows of their own; empty table: empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veltrial.llm.common import shared_checkpoint, table

#: Groups that one bucket's differencing handles, and the most buckets whose sums the driver combines.
BUCKET_GROUPS = 20_000
MAX_BUCKETS = 16_384
#: Rows that one slot-numbering window holds.
SLOT_ROWS = 50_000


def difference(vectors: list[tuple[np.ndarray, object]], n: int) -> tuple[np.ndarray, list]:
    """Combine partial partitions (ascending sums, tag) until one is left.

    Returns its sums and, for each input in order, the permutation p such that
    the input's part i ends in part p[i]."""
    heap = [(-int(v[-1] - v[0]), i, np.asarray(v, np.int64)) for i, (v, _) in enumerate(vectors)]
    heapq.heapify(heap)
    tree: list[tuple | None] = [None] * len(vectors)  # children: (node, permutation from the child's parts)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(total, kind="stable")
        to = np.empty(n, np.int64)
        to[order] = np.arange(n)
        tree.append((a, b, to))
        total = total[order]
        heapq.heappush(heap, (-int(total[-1] - total[0]), len(tree) - 1, total))
    _, root, sums = heap[0]
    place: list[np.ndarray | None] = [None] * len(tree)
    place[root] = np.arange(n)
    for node in range(len(tree) - 1, -1, -1):  # a parent always comes after its children
        if tree[node] is not None and place[node] is not None:
            a, b, to = tree[node]
            place[a] = place[node][to]
            place[b] = place[node][to[::-1]]
    return sums, place[: len(vectors)]


def _bucket(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_bytes", "group_key"], ascending=[False, True], kind="stable", ignore_index=True)
        size = pdf["group_bytes"].to_numpy()
        runs = max(1, -(-len(size) // BUCKET_GROUPS))
        part, tops = np.empty(len(size), np.int64), []
        for r in range(runs):  # a bucket past BUCKET_GROUPS is differenced in runs, and the runs' sums after that
            seeds = []
            for s in size[r::runs]:
                v = np.zeros(n, np.int64)
                v[-1] = s
                seeds.append((v, None))
            sums, place = difference(seeds, n)
            part[r::runs] = [p[n - 1] for p in place]
            tops.append((sums, None))
        sums, place = difference(tops, n)
        for r in range(runs):
            part[r::runs] = place[r][part[r::runs]]
        return pd.DataFrame({"bucket": pdf["bucket"], "group_key": pdf["group_key"], "part": part, "part_bytes": sums[part]})

    return run


def balance_groups(groups: DataFrame, n_shards: int, n_buckets: int) -> DataFrame:
    """groups(group_key binary, group_bytes long) -> (group_key, shard int)."""
    seeded = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(n_buckets)).cast("int"))
    parts = seeded.groupBy("bucket").applyInPandas(_bucket(n_shards), "bucket int, group_key binary, part int, part_bytes long")
    parts = shared_checkpoint(parts)
    # a part's sum is a column of its groups; the driver gets n_shards numbers a bucket
    sums = seeded_sums(parts, n_shards)
    order = sorted(sums)
    if not order:
        return parts.select("group_key", F.col("part").alias("shard"))
    _, place = difference([(sums[b], None) for b in order], n_shards)
    rows = [(b, i, int(p[i])) for b, p in zip(order, place, strict=True) for i in range(n_shards)]
    spark = groups.sparkSession
    mapping = spark.createDataFrame(rows, "bucket int, part int, shard int")  # at most MAX_BUCKETS * n_shards rows
    return parts.join(F.broadcast(mapping), ["bucket", "part"]).select("group_key", "shard")


def seeded_sums(parts: DataFrame, n: int) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("bucket", "part").agg(F.max("part_bytes").alias("b")).toLocalIterator():
        out.setdefault(r["bucket"], np.zeros(n, np.int64))[r["part"]] = r["b"]
    return out


def numbered(rows: DataFrame, keys: list[str], order: list[str], total: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within keys, without one task for a key: rows are
    numbered in chunks of about SLOT_ROWS, then shifted by the chunks before."""
    chunks = max(1, -(-total // SLOT_ROWS))
    cut = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_n"))
        .drop("_n")
    )
    inside = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    return inside.join(before, [*keys, "_chunk"]).withColumn(name, (F.col("_r") - 1 + F.col("_before")).cast("long")).drop("_chunk", "_r", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard,
    slot (gapless from 0 in its shard), grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group_key"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart; fixed by the write
    )
    rows = shared_checkpoint(rows)
    total = rows.count()
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes"))
    buckets = min(MAX_BUCKETS, max(1, -(-total // BUCKET_GROUPS)))
    shards = balance_groups(groups, n_shards, buckets)
    placed = rows.join(shards, "group_key").drop("group_key")
    return numbered(placed, ["shard"], ["row"], total, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
