"""Honest causal forest, grown level by level over the whole table.

Every tree is a heap of nodes (1 at the root, 2 i and 2 i + 1 below i), all trees
grow a level at a time, and a level is one pass: tasks count each node's rows and
outcomes by feature, bin and arm, Spark adds the counts, and the best split of a
node is a window over its bins.  What grows with the table is rows in tasks; a
level's histogram has trees x nodes x features x bins rows, and the driver holds
the splits alone.

Honesty: a hash of tree and id puts a row into the half that chooses splits or the
one that estimates leaves.  Trees come in bags; a bag's trees share one half of the
rows (a hash of bag and id), so the spread of the bags' means measures the
sampling error of the forest (bootstrap of little bags).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("n1", "y1", "n0", "y0")


@dataclass(frozen=True)
class Plan:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]  # upper edges of each feature's bins but the last
    bags: int = 10
    bag_trees: int = 4
    depth: int = 3
    min_leaf: int = 20  # of each arm and side, in the splitting half
    features_a_tree: int | None = None
    seed: int = 0

    @property
    def trees(self) -> int:
        return self.bags * self.bag_trees

    def allowed(self, tree: int) -> list[int]:
        """Features that a tree may split on."""
        k = self.features_a_tree or len(self.features)
        return sorted(np.random.default_rng((self.seed, tree)).permutation(len(self.features))[:k].tolist())


@dataclass
class Forest:
    plan: Plan
    splits: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)  # (tree, node): feature, last bin of the left, gain
    leaves: dict[tuple[int, int], float] = field(default_factory=dict)

    def node_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature (-1: a leaf) and last left bin of every node of every tree."""
        size = 1 << (self.plan.depth + 1)
        feature, cut = np.full((self.plan.trees, size), -1, np.int64), np.zeros((self.plan.trees, size), np.int64)
        for (t, node), (f, b, _) in self.splits.items():
            feature[t, node], cut[t, node] = f, b
        return feature, cut

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        gain = dict.fromkeys(self.plan.features, 0.0)
        for f, _, g in self.splits.values():
            gain[self.plan.features[f]] += g
        total = sum(gain.values())
        return {k: v / total if total else 0.0 for k, v in gain.items()}


def quantile_edges(rows: DataFrame, features: list[str], bins: int = 32, accuracy: int = 1000) -> tuple[tuple[float, ...], ...]:
    """Bin edges at about equal shares of the rows: one pass, bins - 1 numbers a feature."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, accuracy).alias(f) for f in features]).first()
    return tuple(tuple(sorted(set(got[f] or []))) for f in features)


def _odd(*parts: Column | str, seed: int) -> Column:
    """Is the number of the first eight hex digits of the parts' hash odd?  The eighth digit tells."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.instr(F.lit("13579bdf"), F.substring(F.md5(text), 8, 1)) > 0


def prepared(rows: DataFrame, plan: Plan, *, y: str, d: str, id_column: str) -> DataFrame:
    """_y, _d, _bins (of the features) and _role of each tree: 0 splits, 1 estimates, 2 is out."""
    bins = [F.when(F.col(f).isNull(), 0).otherwise(sum((F.col(f).cast("double") > F.lit(float(e))).cast("int") for e in edges) if edges else F.lit(0)) for f, edges in zip(plan.features, plan.edges, strict=True)]
    key = F.col(id_column)
    role = [F.when(_odd("bag", F.lit(t // plan.bag_trees), key, seed=plan.seed), 2).otherwise(_odd("tree", F.lit(t), key, seed=plan.seed).cast("int")) for t in range(plan.trees)]
    fine = F.col(y).isNotNull() & F.col(d).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    return rows.where(fine).select(F.col(y).cast("double").alias("_y"), F.col(d).cast("double").alias("_d"), F.array(*[b.cast("int") for b in bins]).alias("_bins"), F.array(*role).alias("_role"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _walk(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree that each row has come to."""
    node = np.ones(len(bins), np.int64)
    row = np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        right = bins[row, np.maximum(f, 0)] > cut[node]
        node = np.where(inner, 2 * node + right, node)
    return node


def _totals(cell: np.ndarray, size: int, y: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    add = lambda w: np.bincount(cell, w, size)
    return {"n1": add(d), "y1": add(d * y), "n0": add(1 - d), "y0": add((1 - d) * y)}


def _histograms(forest: Forest, level: int):
    plan = forest.plan
    feature, cut = forest.node_tables()
    width = max(len(e) for e in plan.edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = 1 << level
        size = nodes * len(plan.features) * width
        total = {s: np.zeros((plan.trees, size)) for s in SUMS}
        for batch in batches:
            y, d = batch.column("_y").to_numpy(), batch.column("_d").to_numpy()
            bins, role = _matrix(batch.column("_bins"), len(plan.features)), _matrix(batch.column("_role"), plan.trees)
            for t in range(plan.trees):
                own = np.flatnonzero(role[:, t] == 0)
                node = _walk(feature[t], cut[t], bins[own], level)
                at = np.flatnonzero(node >= nodes)  # the others came to a leaf before
                own, node = own[at], node[at] - nodes
                for f in plan.allowed(t):
                    for s, v in _totals((node * len(plan.features) + f) * width + bins[own, f], size, y[own], d[own]).items():
                        total[s][t] += v
        tree, cell = np.nonzero(total["n1"] + total["n0"])
        rest, b = np.divmod(cell, width)
        node, f = np.divmod(rest, len(plan.features))
        yield pa.RecordBatch.from_pydict({"tree": tree, "node": node + nodes, "feature": f, "bin": b} | {s: total[s][tree, cell] for s in SUMS})

    return run


def best_splits(histogram: DataFrame, min_leaf: int) -> DataFrame:
    """tree, node, feature, bin (the last one on the left) and gain of the split
    whose sides' effects differ most: n_left effect_left^2 + n_right effect_right^2,
    above that of the node; the smallest feature and bin of equal ones."""
    sums = histogram.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(s).alias(s) for s in SUMS])
    cell = Window.partitionBy("tree", "node", "feature")
    upto = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = sums.select("tree", "node", "feature", "bin", *[F.sum(s).over(upto).alias(f"l_{s}") for s in SUMS], *[F.sum(s).over(cell).alias(f"a_{s}") for s in SUMS])
    sides = sides.select("*", *[(F.col(f"a_{s}") - F.col(f"l_{s}")).alias(f"r_{s}") for s in SUMS])
    effect = lambda p: F.try_divide(F.col(f"{p}_y1"), F.col(f"{p}_n1")) - F.try_divide(F.col(f"{p}_y0"), F.col(f"{p}_n0"))
    worth = lambda p: (F.col(f"{p}_n1") + F.col(f"{p}_n0")) * effect(p) ** 2
    large = F.least(*[F.col(f"{p}_{n}") for p in "lr" for n in ("n1", "n0")]) >= min_leaf
    gains = sides.where(large).select("tree", "node", "feature", "bin", (worth("l") + worth("r") - worth("a")).alias("gain")).where("gain > 0")
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.desc(F.round("gain", 6)), "feature", "bin"))
    return gains.withColumn("_r", first).where("_r = 1").drop("_r")


def _leaf_sums(forest: Forest):
    plan = forest.plan
    feature, cut = forest.node_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (plan.depth + 1)
        total = {s: np.zeros((plan.trees, size)) for s in SUMS}
        for batch in batches:
            y, d = batch.column("_y").to_numpy(), batch.column("_d").to_numpy()
            bins, role = _matrix(batch.column("_bins"), len(plan.features)), _matrix(batch.column("_role"), plan.trees)
            for t in range(plan.trees):
                own = np.flatnonzero(role[:, t] == 1)
                for s, v in _totals(_walk(feature[t], cut[t], bins[own], plan.depth), size, y[own], d[own]).items():
                    total[s][t] += v
        tree, node = np.nonzero(total["n1"] + total["n0"])
        yield pa.RecordBatch.from_pydict({"tree": tree, "node": node} | {s: total[s][tree, node] for s in SUMS})

    return run


def grow(rows: DataFrame, plan: Plan, *, y: str, d: str, id_column: str) -> Forest:
    """Splits from one half of each tree's rows, leaves' effects from the other.
    A leaf without both arms takes the effect of the nearest node above that has them."""
    data = prepared(rows, plan, y=y, d=d, id_column=id_column)
    forest = Forest(plan)
    kinds = "tree long, node long, feature long, bin long, " + ", ".join(f"{s} double" for s in SUMS)
    for level in range(plan.depth):
        found = best_splits(data.mapInArrow(_histograms(forest, level), kinds), plan.min_leaf).collect()  # a row a node
        if not found:
            break
        forest.splits |= {(r["tree"], r["node"]): (r["feature"], r["bin"], r["gain"]) for r in found}
    kinds = "tree long, node long, " + ", ".join(f"{s} double" for s in SUMS)
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in data.mapInArrow(_leaf_sums(forest), kinds).groupBy("tree", "node").agg(*[F.sum(s).alias(s) for s in SUMS]).collect():
        node, own = r["node"], np.array([r[s] for s in SUMS])
        while node:
            sums[r["tree"], node] = sums.get((r["tree"], node), 0) + own
            node //= 2
    for t in range(plan.trees):
        for node in [1, *(2 * n + side for (tree, n) in forest.splits if tree == t for side in (0, 1))]:
            at = node
            while at > 1 and not (sums.get((t, at), np.zeros(4))[[0, 2]] > 0).all():
                at //= 2
            n1, y1, n0, y0 = sums.get((t, at), np.zeros(4))
            forest.leaves[t, node] = y1 / n1 - y0 / n0 if n1 and n0 else float("nan")
    return forest


def splits_table(forest: Forest, spark) -> DataFrame:
    """tree, node, feature, bin, gain and the honest effects on both sides."""
    rows = [(t, n, forest.plan.features[f], b, float(g), float(forest.leaves[t, 2 * n]), float(forest.leaves[t, 2 * n + 1])) for (t, n), (f, b, g) in sorted(forest.splits.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, gain double, left_effect double, right_effect double")


def predict(rows: DataFrame, forest: Forest) -> DataFrame:
    """Adds cate and its standard error: the spread of the bags' means, less what
    the few trees of a bag add to it."""
    plan = forest.plan
    feature, cut = forest.node_tables()
    effect = np.full(feature.shape, np.nan)
    for (t, node), value in forest.leaves.items():
        effect[t, node] = value
    edges = [np.array(e) for e in plan.edges]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, cate double, cate_se double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([np.searchsorted(e, np.nan_to_num(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-np.inf), "left") for f, e in zip(plan.features, edges, strict=True)], axis=1)
            each = np.stack([effect[t][_walk(feature[t], cut[t], bins, plan.depth)] for t in range(plan.trees)])
            bags = each.reshape(plan.bags, plan.bag_trees, -1)
            means = bags.mean(1)
            between = means.var(0, ddof=1) if plan.bags > 1 else np.full(len(bins), np.nan)
            within = bags.var(1, ddof=1).mean(0) / plan.bag_trees if plan.bag_trees > 1 else 0.0
            error = np.sqrt(np.maximum(between - within, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each.mean(0)), pa.array(error)], names=[*batch.schema.names, "cate", "cate_se"])

    return rows.mapInArrow(run, schema)
