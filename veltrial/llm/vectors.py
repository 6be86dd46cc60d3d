"""Exact top-k inner-product search with vector-approximation files.

Vectors are integers (floor(64 * x)).

1. Data go to the nearest of at most CENTROIDS sampled vectors, in blocks of at
   most about BLOCK_ROWS.  A block's approximation file, built once, holds for
   each vector and dimension the number of its cell among at most CELLS quantile
   cells, and each cell's least and greatest value: a byte a component.
2. Queries form blocks in the same way.  The k-th best score against the sample
   is a floor under a query's k-th best score; a data block whose outer cells
   can't reach the floor of any query of a block is never sent to it.
3. A pair of blocks is one task's work: the cells give a lower and an upper bound
   of each score; what lies under the k-th best lower bound goes.
4. Over all blocks, the k-th best lower bound of a query cuts the rest again.
   Exact vectors are read of these alone, in order of their upper bounds: the
   first k, and then those whose bound reaches the k-th exact score, after which
   the result is certain.

The stated query set meets all rows, in blocks; what travels for a pair of
blocks is codes, not vectors.

Defined cases: a vector that is null, or holds a null or non-finite component
(times 64, too), and one without an id take no part; vectors of different length
never meet; a query never meets a row of its own id; repeated rows are candidates
each; ties go to the smaller vec_id; scores are exact integers whatever the
components' size, and those beyond a long are the nearest long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veltrial.llm.common import shared_checkpoint, table

SCALE = 64
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
CELLS = 256
#: Sampled vectors that set the floors, and those of them that the blocks gather around.
SAMPLE_ROWS, CENTROIDS = 2048, 256
#: Block summaries that one task compares with a query block.
SUMMARIES = 1024
#: Doubles hold integers below this exactly.
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (uint8) and each cell's least and greatest value, by dimension."""
    n, d = vectors.shape
    codes = np.empty((n, d), np.uint8)
    low, high = np.zeros((d, cells)), np.zeros((d, cells))
    for j in range(d):
        column = vectors[:, j]
        marks = np.unique(np.quantile(column, np.arange(1, cells) / cells))
        code = np.searchsorted(marks, column, "right")
        codes[:, j] = code
        order = np.argsort(code, kind="stable")
        edge = np.flatnonzero(np.diff(code[order], prepend=-1))
        low[j, code[order][edge]] = np.minimum.reduceat(column[order], edge)
        high[j, code[order][edge]] = np.maximum.reduceat(column[order], edge)
    return codes, low, high


def score_bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with boxes (rows of least and most)."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle, half = least / 2 + most / 2, most / 2 - least / 2
        centre = queries @ middle.T
        reach = np.abs(queries) @ half.T if half.any() else 0.0  # cells of one value each have no width
        slack = 0.0  # of rounding: none where all sums stay whole
        if not np.abs(queries).max(initial=0) * max(np.abs(least).max(initial=0), np.abs(most).max(initial=0)) * queries.shape[1] < EXACT / 4:
            size = np.abs(queries) @ np.maximum(np.abs(least), np.abs(most)).T
            slack = np.where(size < EXACT / 4, 0.0, size * (queries.shape[1] + 4) * 2.0**-51)
        lower, upper = centre - reach - slack, centre + reach + slack
    return np.nan_to_num(lower, nan=-np.inf, neginf=-np.inf, posinf=np.inf), np.nan_to_num(upper, nan=np.inf, neginf=-np.inf, posinf=np.inf)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of integer matrices, held to a long's range."""
    with np.errstate(over="ignore"):
        size = np.abs(a).max(1, initial=0) * np.abs(b).max(1, initial=0) * a.shape[1]
    fine = size < EXACT
    out = np.zeros(len(a), np.int64)
    out[fine] = np.einsum("ij,ij->i", a[fine], b[fine]).astype(np.int64)
    for i in np.flatnonzero(~fine):
        total = sum(int(x) * int(y) for x, y in zip(a[i], b[i], strict=True))
        out[i] = max(-MOST, min(MOST, total))
    return out


def scan_block(ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, rows: dict, k: int) -> tuple[np.ndarray, ...]:
    """(query's place, row's place, lower, upper) of what a block's file can't rule out."""
    codes, low, high = rows["codes"], rows["low"], rows["high"]
    dims = np.arange(codes.shape[1])
    least, most = low[dims, codes], high[dims, codes]
    out = []
    for at in range(0, len(queries), 256):
        lower, upper = score_bounds(queries[at : at + 256], least, most)
        for i in range(len(lower)):
            q = at + i
            other = rows["ids"] != ids[q]
            bound = floor[q]
            if other.sum() >= k:
                own = lower[i][other]
                bound = max(bound, np.partition(own, len(own) - k)[len(own) - k])
            near = np.flatnonzero((upper[i] >= bound) & other)
            out.append((np.full(len(near), q), near, lower[i][near], upper[i][near]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def integer_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (doubles that are integers): the rows that take part."""
    x = F.transform(F.col(column), lambda c: F.lit(float(scale)) * c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))  # beyond, all doubles are integers
    return df.where(F.col(id_column).isNotNull() & fine & (F.size(x) > 0)).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


class Sample:
    """At most SAMPLE_ROWS vectors, by their length."""

    def __init__(self, rows: list, blocks: int):
        self.ids: dict[int, np.ndarray] = {}
        self.vectors: dict[int, np.ndarray] = {}
        for d in {len(r["v"]) for r in rows}:
            own = [r for r in rows if len(r["v"]) == d]
            self.ids[d] = np.array([r["vec_id"] for r in own], np.int64)
            self.vectors[d] = np.array([r["v"] for r in own], float)
        self.centroids = min(CENTROIDS, blocks)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid (0 where the sample has none of this length)."""
        c = self.vectors.get(v.shape[1])
        if c is None:
            return np.zeros(len(v), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            c = c[: self.centroids]
            far = (c * c).sum(1) - 2 * v @ c.T
        return np.nan_to_num(far, nan=np.inf).argmin(1)

    def floors(self, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
        """A number that each query's k-th best score can't be under."""
        own = self.vectors.get(v.shape[1])
        if own is None or len(own) <= k:
            return np.full(len(v), -np.inf)
        lower, _ = score_bounds(v, own, own)
        lower[ids[:, None] == self.ids[v.shape[1]][None, :]] = -np.inf
        return np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, own in pdf.groupby(pdf["v"].map(len)):
        yield own, np.stack(own["v"].to_numpy()).astype(float)


def _placed(sample: Sample, k: int | None) -> Callable:
    """Adds the length, the centroid and, for queries, the floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, v in _by_length(pdf):
                own = own.assign(dim=v.shape[1], centroid=sample.nearest(v))
                own["floor"] = -np.inf if k is None else sample.floors(own["vec_id"].to_numpy(np.int64), v, k)
                yield own

    return run


PLACED = "row long, vec_id long, v array<double>, dim int, centroid int, floor double"


def _in_blocks(frame: DataFrame, rows: int) -> DataFrame:
    """Adds part: each length and centroid is cut into parts of about ``rows``."""
    sizes = frame.groupBy("dim", "centroid").agg(F.ceil(F.count("*") / rows).alias("parts"))
    return frame.join(sizes, ["dim", "centroid"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")


FILES = "dim int, block string, n int, rows binary, ids binary, codes binary, low binary, high binary, least array<double>, most array<double>"


def _file(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(float)
    codes, low, high = approximate(v)
    name = "-".join(map(str, key))
    return pd.DataFrame([[key[0], name, len(v), pdf["row"].to_numpy("<i8").tobytes(), pdf["vec_id"].to_numpy("<i8").tobytes(), codes.tobytes(), low.tobytes(), high.tobytes(), v.min(0), v.max(0)]], columns=["dim", "block", "n", "rows", "ids", "codes", "low", "high", "least", "most"])


QUERY_BLOCKS = "dim int, query_block string, n int, query_rows binary, query_ids binary, vectors binary, floors binary"


def _query_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype("<f8")
    name = "-".join(map(str, key))
    return pd.DataFrame([[key[0], name, len(v), pdf["row"].to_numpy("<i8").tobytes(), pdf["vec_id"].to_numpy("<i8").tobytes(), v.tobytes(), pdf["floor"].to_numpy("<f8").tobytes()]], columns=["dim", "query_block", "n", "query_rows", "query_ids", "vectors", "floors"])


def _reached(queries: pd.DataFrame, summaries: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a query block and the data blocks that one of its floors reaches."""
    out = []
    for q in queries.itertuples():
        v, floor = np.frombuffer(q.vectors, "<f8").reshape(q.n, q.dim), np.frombuffer(q.floors, "<f8")
        least, most = np.stack(summaries["least"].to_numpy()), np.stack(summaries["most"].to_numpy())
        _, upper = score_bounds(v, least, most)
        out += [(q.query_block, b) for b in summaries["block"].to_numpy()[(upper >= floor[:, None]).any(0)]]
    return pd.DataFrame(out, columns=["query_block", "block"], dtype=str)


def _pair(k: int) -> Callable:
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for q, f in ((q, f) for q in queries.itertuples() for f in data.itertuples()):
            ids = np.frombuffer(q.query_ids, "<i8")
            file = {"ids": np.frombuffer(f.ids, "<i8"), "codes": np.frombuffer(f.codes, np.uint8).reshape(f.n, f.dim), "low": np.frombuffer(f.low, "<f8").reshape(f.dim, -1), "high": np.frombuffer(f.high, "<f8").reshape(f.dim, -1)}
            at, near, lower, upper = scan_block(ids, np.frombuffer(q.vectors, "<f8").reshape(q.n, q.dim), np.frombuffer(q.floors, "<f8"), file, k)
            parts.append(pd.DataFrame({"query_row": np.frombuffer(q.query_rows, "<i8")[at], "row": np.frombuffer(f.rows, "<i8")[near], "lower": lower, "upper": upper}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_row": [], "row": [], "lower": [], "upper": []})

    return run


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score = np.zeros(len(pdf), np.int64)
        length = pdf["v"].map(len).to_numpy()
        for d in np.unique(length):
            own = length == d
            score[own] = exact_scores(np.stack(pdf["q"].to_numpy()[own]).astype(float), np.stack(pdf["v"].to_numpy()[own]).astype(float))
        yield pd.DataFrame({"query_row": pdf["query_row"], "query_id": pdf["query_id"], "vec_id": pdf["vec_id"], "score": score})


SCORED = "query_row long, query_id long, vec_id long, score long"


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """queries, data: (vec_id long, v array<double>) -> query_id, rank, vec_id, score."""
    number = F.monotonically_increasing_id().alias("row")
    data = shared_checkpoint(data.select(number, "vec_id", "v"))
    queries = shared_checkpoint(queries.select(number, "vec_id", "v"))
    n = data.count()
    share = F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE_ROWS))) == 0
    sample = Sample(data.where(share).select("vec_id", "v").limit(SAMPLE_ROWS).collect(), max(1, -(-n // BLOCK_ROWS)))
    placed = data.mapInPandas(_placed(sample, None), PLACED)
    files = shared_checkpoint(_in_blocks(placed, BLOCK_ROWS).groupBy("dim", "centroid", "part").applyInPandas(_file, FILES))
    asked = queries.mapInPandas(_placed(sample, k), PLACED)
    blocks = shared_checkpoint(_in_blocks(asked, QUERY_ROWS).groupBy("dim", "centroid", "part").applyInPandas(_query_block, QUERY_BLOCKS))

    summaries = files.select("dim", "block", "least", "most", F.pmod(F.xxhash64("block"), F.lit(max(1, files.count() // SUMMARIES))).cast("int").alias("chunk"))
    chunks = summaries.select(F.col("dim").alias("of_dim"), F.col("chunk").alias("of_chunk")).distinct()
    pairs = blocks.join(chunks, F.col("dim") == F.col("of_dim")).groupBy("of_dim", "of_chunk").cogroup(summaries.groupBy("dim", "chunk")).applyInPandas(_reached, "query_block string, block string")
    pairs = shared_checkpoint(pairs)
    asking = pairs.select("query_block", F.col("block").alias("data_block")).join(blocks, "query_block")
    answering = pairs.select(F.col("query_block").alias("for_query_block"), "block").join(files, "block")
    near = asking.groupBy("query_block", "data_block").cogroup(answering.groupBy("for_query_block", "block")).applyInPandas(_pair(k), "query_row long, row long, lower double, upper double")
    near = shared_checkpoint(near)

    by_query = Window.partitionBy("query_row")
    best_lower = near.withColumn("_r", F.row_number().over(by_query.orderBy(F.desc("lower"), "row"))).where(F.col("_r") <= k)
    floor = best_lower.groupBy("query_row").agg(F.min("lower").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    left = near.join(floor, "query_row", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("query_row", "row", "upper")
    left = left.withColumn("order", F.row_number().over(by_query.orderBy(F.desc("upper"), "row")))

    def read(rows: DataFrame) -> DataFrame:
        exact = rows.join(data, "row").join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_row")
        return exact.select("query_row", "query_id", "vec_id", "v", "q").mapInPandas(_exact, SCORED)

    first = shared_checkpoint(read(left.where(F.col("order") <= k)))
    certain = first.groupBy("query_row").agg(F.min("score").cast("double").alias("least"))
    second = read(left.where(F.col("order") > k).join(certain, "query_row").where(F.col("upper") >= F.col("least")))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vectors(spark, sf_dir: str) -> DataFrame:
    data = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(data.where(F.col("vec_id") % 20 == 0), data, 20)


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
      FROM e q JOIN e d ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
