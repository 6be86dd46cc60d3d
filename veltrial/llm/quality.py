"""Quality classifier learned from trusted positives and unlabelled web text.

Non-negative positive-unlabelled learning: with class prior p, the risk of a
linear scorer is p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]);
where the second term goes negative, the step climbs back out of it.  The prior
is estimated from the same two samples: the least ratio, over score thresholds,
of the unlabelled share above the threshold to the positive share above it.

Trusted positives are rows of ``labels`` with quality 1; rows with quality 0 are
not used.  Both samples are bounded (POSITIVES, UNLABELLED rows, distinct
ones, chosen by a hash of id and text); scoring covers every document.

Features: shares of ordered pairs of character classes, share of words that
repeat the one before, share of distinct words, word length, text length.

Defined cases: null text counts as empty; the empty text has all-zero shares and
is scored like any other; ids with several labels count once, as 1 if any is 1;
no positive at all: every score is 0.5; repeated rows stay rows of their own;
empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import TextBlock, hash_ranges, rows_of, sampled, table, text_blocks

POSITIVES, UNLABELLED = 6000, 12_000
STEPS, RATE, DECAY = 400, 0.05, 0.1

_CLASSES = ["\n\r", " \t", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "'\"()-", "|/\\_=<>[]{}", "#$%&*@^~+`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)  # what is left: control and non-ASCII bytes
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_N = len(_CLASSES) + 1
FEATURES = _N * _N + _N + 5


def features(block: TextBlock) -> np.ndarray:
    """(rows, FEATURES) of a block made with the separator b'\\n'."""
    rows = len(block.starts) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    kind = _CLASS[block.data]
    row = np.repeat(np.arange(rows), np.diff(block.starts))
    size = np.maximum(np.diff(block.starts) - 1, 1)[:, None]
    pair = kind[:-1] * _N + kind[1:]
    inner = row[:-1] == row[1:]
    inner[np.maximum(block.starts[1:] - 2, 0)] = False  # the pair with the separator
    out[:, : _N * _N] = np.bincount(row[:-1][inner] * _N * _N + pair[inner], minlength=rows * _N * _N).reshape(rows, -1) / size
    single = np.bincount(row * _N + kind, minlength=rows * _N).reshape(rows, -1)
    single[:, 0] -= 1
    out[:, _N * _N : _N * _N + _N] = single / size
    inside = kind > 1
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[0::2], edge[1::2]
    n_words = np.zeros(rows)
    if len(begin):
        word_row = rows_of(begin, block.starts)
        h = hash_ranges(block.data, begin, end)
        n_words = np.bincount(word_row, minlength=rows)
        again = np.flatnonzero((h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1]))
        order = np.lexsort((h, word_row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
        least = np.maximum(n_words, 1)
        out[:, -5] = np.bincount(word_row[1:][again], minlength=rows) / least
        # distinct words grow as about the 0.8th power of all: compare with that, not with all
        out[:, -4] = np.minimum(np.bincount(word_row[order][fresh], minlength=rows) / least**0.8, 3)
        out[:, -3] = np.log1p(np.bincount(word_row, weights=end - begin, minlength=rows) / least)
    out[:, -2] = np.log1p(n_words)
    out[:, -1] = np.log1p(size[:, 0])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -5, 5) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient: Callable, width: int) -> np.ndarray:
    """Adam over weights and bias."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """positive, unlabelled: standardised features with a column of ones."""
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    p, u = positive[half_p], unlabelled[half_u]
    keep = np.r_[np.ones(p.shape[1] - 1), 0]
    w = _descend(lambda w: -(p.T @ _sigmoid(-p @ w)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + DECAY * keep * w, p.shape[1])
    p, u = positive[~half_p] @ w, unlabelled[~half_u] @ w
    if not len(p) or not len(u):
        return 0.5
    above = np.quantile(p, np.linspace(0.01, 0.7, 40))
    ratio = [(u >= t).mean() / max((p >= t).mean(), 1e-9) for t in above]
    return float(np.clip(min(ratio), 0.05, 0.97))


def _parts(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the positives, and of the negatives as the unlabelled rows less
    the positives' share of them (logistic loss)."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def non_negative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """Positive-unlabelled risk of scores, the negatives' part held at 0."""
    plus, minus = _parts(zp, zu, prior)
    return float(plus + max(minus, 0.0))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk; where the negatives' part is below 0, the step that leads it back up."""
    zp, zu = p @ w, u @ w
    g_pos = -prior * (p.T @ _sigmoid(-zp)) / len(p)
    g_rest = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    return g_pos + g_rest if _parts(zp, zu, prior)[1] >= 0 else -g_rest


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled]).astype(float)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    one = lambda x: np.c_[np.clip((x - mean) / scale, -5, 5), np.ones(len(x))]
    p, u = one(positive), one(unlabelled)
    prior = estimate_prior(p, u)
    keep = np.r_[np.ones(FEATURES), 0]

    w = _descend(lambda w: risk_gradient(w, p, u, prior) + DECAY * keep * w, FEATURES + 1)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column("text"), separator=b"\n"):
            x = features(block)
            yield pa.RecordBatch.from_arrays([batch.column("positive").slice(block.lo, block.hi - block.lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, quality; only rows with quality 1 are used."""
    known = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    positives = sampled(docs.select("doc_id").join(known, "doc_id", "left_semi"), POSITIVES, ("doc_id",))  # of ids that have a text
    text = docs.select("doc_id", "text")
    # about POSITIVES ids at most; an id may have any number of rows, so those are sampled too
    p = sampled(text.join(F.broadcast(positives), "doc_id", "left_semi"), POSITIVES).withColumn("positive", F.lit(True))
    u = sampled(text, UNLABELLED).withColumn("positive", F.lit(False))
    rows = p.unionByName(u).select("positive", "text").mapInArrow(_feature_rows, "positive boolean, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, FEATURES)
    is_positive = rows["positive"].to_numpy(bool)
    return fit(x[is_positive], x[~is_positive])


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text"), separator=b"\n"):
                s = model.score(features(block))
                part = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = model or train(docs, labels.where(~held_out()))
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
