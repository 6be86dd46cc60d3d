"""Effects that vary between units: cross-fitted learners on pyspark.ml."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veltrial.operators.regression import gram


def folds(frame: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """A fold by a hash of the id: a retried task gets the same folds."""
    return frame.withColumn("fold", F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(n)).cast("int"))


def _features(frame: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(frame)


def forest_learner(seed: int = 0, trees: int = 20, depth: int = 5):
    return lambda: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)


def _predict(learner, train: DataFrame, score: DataFrame, label: str, out: str, features: list[str], weight: str | None = None) -> DataFrame:
    model = learner().setFeaturesCol("_f").setLabelCol(label).setPredictionCol(out)
    model = model.setWeightCol(weight) if weight else model
    return model.fit(_features(train, features, "_f")).transform(_features(score, features, "_f")).drop("_f")


def cross_fit(frame: DataFrame, label: str, out: str, features: list[str], n_folds: int, learner, only: Column | None = None) -> DataFrame:
    """Predictions of each fold by a model of the others (of rows where ``only``)."""
    parts = []
    for k in range(n_folds):
        train = frame.where(F.col("fold") != k)
        parts.append(_predict(learner, train if only is None else train.where(only), frame.where(F.col("fold") == k), label, out, features))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def nuisances(frame: DataFrame, *, y: str, d: str, features: list[str], id_column: str, n_folds: int = 5, learner=None, clip: float = 0.02, seed: int = 0, fold: Column | None = None) -> DataFrame:
    """Adds mu1, mu0, mu and propensity, all cross-fitted; ``fold`` (0 to n_folds - 1) in the hash's place."""
    learner = learner or forest_learner(seed)
    out = folds(frame, id_column, n_folds, seed) if fold is None else frame.withColumn("fold", fold.cast("int"))
    out = cross_fit(out, y, "mu", features, n_folds, learner)
    out = cross_fit(out, d, "propensity", features, n_folds, learner)
    out = cross_fit(out, y, "mu1", features, n_folds, learner, F.col(d) == 1)
    out = cross_fit(out, y, "mu0", features, n_folds, learner, F.col(d) == 0)
    return out.withColumn("propensity", F.least(F.greatest("propensity", F.lit(clip)), F.lit(1 - clip)))


def dml_effect(scored: DataFrame, y: str, d: str) -> dict:
    """Residual on residual: the partially linear effect and its error, two aggregates."""
    ry, rd = F.col(y) - F.col("mu"), F.col(d) - F.col("propensity")
    s = scored.agg(F.sum(ry * rd).alias("yd"), F.sum(rd * rd).alias("dd"), F.count("*").alias("n")).first()
    theta = s["yd"] / s["dd"]
    e = ry - theta * rd
    meat = scored.agg(F.sum(e * e * rd * rd)).first()[0]
    return {"effect": theta, "std_error": meat**0.5 / s["dd"], "n": s["n"]}


def plugin_effect(frame: DataFrame, y: str, d: str, features: list[str]) -> float:
    """Coefficient of d beside the features, for comparison."""
    cols = {"1": F.lit(1.0)} | {c: F.col(c).cast("double") for c in [d, *features]} | {"__y": F.col(y).cast("double")}
    import numpy as np

    _, m = gram(frame, cols)
    return float((np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1])[1])


def s_learner(frame: DataFrame, *, y: str, d: str, features: list[str], learner=None) -> DataFrame:
    """One model with the treatment as a feature; adds cate."""
    learner = learner or forest_learner()
    model = learner().setFeaturesCol("_f").setLabelCol(y).setPredictionCol("_p").fit(_features(frame, [*features, d], "_f"))
    for name, v in (("_one", 1.0), ("_zero", 0.0)):
        frame = model.transform(_features(frame.withColumn("_d", F.lit(v)), [*features, "_d"], "_f")).withColumnRenamed("_p", name).drop("_f", "_d")
    return frame.withColumn("cate", F.col("_one") - F.col("_zero")).drop("_one", "_zero")


def t_learner(frame: DataFrame, *, y: str, d: str, features: list[str], learner=None) -> DataFrame:
    learner = learner or forest_learner()
    out = _predict(learner, frame.where(F.col(d) == 1), frame, y, "_one", features)
    out = _predict(learner, frame.where(F.col(d) == 0), out, y, "_zero", features)
    return out.withColumn("cate", F.col("_one") - F.col("_zero")).drop("_one", "_zero")


def x_learner(frame: DataFrame, *, y: str, d: str, features: list[str], propensity: Column | float = 0.5, learner=None) -> DataFrame:
    """Imputed effects of each arm, weighted by the propensity."""
    learner = learner or forest_learner()
    out = _predict(learner, frame.where(F.col(d) == 1), frame, y, "_one", features)
    out = _predict(learner, frame.where(F.col(d) == 0), out, y, "_zero", features)
    out = out.withColumn("_i", F.when(F.col(d) == 1, F.col(y) - F.col("_zero")).otherwise(F.col("_one") - F.col(y)))
    out = _predict(learner, out.where(F.col(d) == 1), out, "_i", "_t1", features)
    out = _predict(learner, out.where(F.col(d) == 0), out, "_i", "_t0", features)
    p = propensity if isinstance(propensity, Column) else F.lit(propensity)
    return out.withColumn("cate", p * F.col("_t0") + (1 - p) * F.col("_t1")).drop("_one", "_zero", "_i", "_t1", "_t0")


def r_learner(scored: DataFrame, *, y: str, d: str, features: list[str], learner=None) -> DataFrame:
    """Weighted regression of residual ratios; needs ``nuisances``."""
    learner = learner or forest_learner()
    rd = F.col(d) - F.col("propensity")
    out = scored.withColumn("_w", rd * rd).withColumn("_t", (F.col(y) - F.col("mu")) / rd)
    return _predict(learner, out, out, "_t", "cate", features, "_w").drop("_w", "_t")


def dr_learner(scored: DataFrame, *, y: str, d: str, features: list[str], learner=None, clip: float = 0.02) -> DataFrame:
    """Regression of doubly robust scores; needs ``nuisances``."""
    from veltrial.operators.targeting import aipw_scores

    learner = learner or forest_learner()
    out = aipw_scores(scored, y=y, d=d, mu1="mu1", mu0="mu0", propensity="propensity", clip=clip)
    return _predict(learner, out, out, "gamma", "cate", features)
