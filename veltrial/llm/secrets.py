"""Secret scans.

Three fixed patterns find the base spans.  A pair of first-order character
Markov models, one of random strings and one of ordinary identifiers, adds
spans: a run of token characters is a secret when the log-likelihood ratio of
the two models exceeds the prior odds, and so is the best segment of a run that
as a whole does not.

Labelled samples.  Random: the values that the base patterns capture, and seeded
random strings over common key alphabets.  Ordinary: every other token of the
sampled documents, alone, in capitals and joined to snake_case and camelCase.  The sample
holds about ``sample_docs`` documents chosen by a hash of the id; only bigram
counts leave the executors, by a partial aggregation.

Defined cases: null or empty text has no span; spans of one kind never overlap;
of a model span that touches a base span, the parts outside it that
score alone are kept; repeated rows and ids are
kept as they are; empty table: empty result; other columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import released, sampled, table

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

#: Characters of a candidate, and its least length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, SIGNS = 16, frozenset("+/_=-")
#: Prior odds of an ordinary run against a secret, as a natural logarithm.
PRIOR_ODDS = float(np.log(1e4))
SAMPLE_DOCS = 4000

_CODE = np.full(128, len(ALPHABET) + 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_STATES = len(ALPHABET) + 2  # 0: the border


def base_spans(text: str, has: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    if has[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if has[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if has[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def transitions(strings: list[str]) -> np.ndarray:
    """Pairs of character codes, borders included, as state * _STATES + next."""
    raw = np.frombuffer(("\x00" + "\x00".join(strings) + "\x00").encode("ascii", "replace"), np.uint8)
    code = np.where(raw == 0, 0, _CODE[np.minimum(raw, 127)])
    return code[:-1] * _STATES + code[1:]


def _seeded_random(n: int = 4000) -> list[str]:
    rng = np.random.default_rng(7)
    sets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-"]
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(16, 48)))) for i in range(n)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _STATES * _STATES), np.int64)
    for batch in batches:
        for text in pc.fill_null(batch.column("text"), "").to_pylist():
            spans = base_spans(text)
            secret, cut, at = [], [], 0
            for s, kind, e in sorted(spans):
                secret.append(text[s:e] if kind else ASSIGN.match(text, s)[2])
                if s >= at:
                    cut.append(text[at:s])
                at = max(at, e)
            cut.append(text[at:])
            plain = re.findall(r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*", " ".join(cut))
            joined = ["_".join(plain[i : i + 3]) for i in range(0, len(plain), 7)] + ["".join(w.capitalize() for w in plain[i : i + 3]) for i in range(0, len(plain), 11)]
            capitals = [x.upper() for x in plain[::7] + joined[::5]]
            for label, strings in ((0, plain + joined + capitals), (1, secret)):
                if strings:
                    total[label] += np.bincount(transitions(strings), minlength=_STATES * _STATES)
    for label in (0, 1):
        pair = np.flatnonzero(total[label])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), label), pa.int32()), pa.array(pair, pa.int32()), pa.array(total[label][pair], pa.int64())], names=["label", "pair", "n"])


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Transition probabilities, drawn to those of the characters' kinds (case,
    digit, sign, border) where a character was seen rarely."""
    kind = np.zeros(_STATES, np.int64)
    for k, chars in enumerate((ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62], ALPHABET[62:]), 1):
        kind[_CODE[[ord(c) for c in chars]]] = k
    kind[-1] = 5
    member = np.eye(6)[kind]
    by_kind = member.T @ counts @ member + 1.0
    by_kind /= by_kind.sum(1, keepdims=True)
    prior = by_kind[kind][:, kind] / member.sum(0)[kind]
    smooth = counts + 20.0 * prior
    return smooth / smooth.sum(1, keepdims=True)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each transition."""
    sample = sampled(docs.select("doc_id", "text"), sample_docs, once=False).select("text")
    counts = np.zeros((2, _STATES * _STATES))
    # at most 2 * _STATES^2 rows
    for r in sample.mapInArrow(released(_count), "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"]] = r["n"]
    counts[1] += np.bincount(transitions(_seeded_random()), minlength=_STATES * _STATES)
    logp = np.log(np.stack([_probabilities(c.reshape(_STATES, _STATES)) for c in counts]))
    return logp[1] - logp[0]


def _best_segment(llr: np.ndarray) -> tuple[float, int, int]:
    """Score and range of the characters a..b of a run, LEAST at least, whose
    transitions score most; those at the run's borders count for its ends."""
    n = len(llr) - 1
    total = np.concatenate([[0.0], np.cumsum(llr)])
    # a segment from the first character on takes the border's transition with it, and so at the end
    start = np.concatenate([[0.0], total[2 : n + 1]])
    stop = np.concatenate([total[1:n], [total[n + 1]]])
    low = np.minimum.accumulate(start[: n - LEAST + 1])
    gain = stop[LEAST - 1 :] - low
    k = int(gain.argmax())
    return float(gain[k]), int(start[: k + 1].argmin()), k + LEAST


def _segments(s: str, llr: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a run that the models call random: the run, or else its best
    segments, each to the signs around it, so that no end of a key is left."""
    if llr.sum() > PRIOR_ODDS:
        yield 0, len(s)
        return
    todo = [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        score, a, b = _best_segment(llr[lo : hi + 1])
        if score > PRIOR_ODDS:
            a, b = lo + a, lo + b
            while a > lo and s[a - 1] not in SIGNS:
                a -= 1
            while b < hi and s[b] not in SIGNS:
                b += 1
            yield a, b
            todo += [(lo, a), (b, hi)]


def _outside(span: tuple[int, int], base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no base span covers."""
    at = span[0]
    for x, y in sorted(base):
        if y > at and x < span[1]:
            if x > at:
                yield at, x
            at = max(at, y)
    if at < span[1]:
        yield at, span[1]


class _Near:
    """Spans of a text, to find those that touch another one without looking at all."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.ends = list(itertools.accumulate((b for _, b in self.spans), max))

    def touching(self, a: int, b: int) -> list[tuple[int, int]]:
        return [x for x in self.spans[bisect.bisect_right(self.ends, a) : bisect.bisect_left(self.starts, b)] if x[1] > a]


def random_spans(texts: list[str], ratio: np.ndarray, base: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int]]]:
    """Parts of runs of token characters that the models call random, for each
    text, outside its base spans."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    found = [(i, m.start(), m[0]) for i, text in enumerate(texts) for m in CANDIDATE.finditer(text)]
    if not found:
        return out
    flat = ratio.reshape(-1)
    llr = flat[transitions([s for _, _, s in found])]
    at, last, near = 0, -1, _Near([])
    for i, start, s in found:
        own = llr[at : at + len(s) + 1]
        at += len(s) + 1
        if i != last and base:
            last, near = i, _Near(base[i])
        for a, b in _segments(s, own):
            span = (start + a, start + b)
            touched = near.touching(*span)
            if not touched:
                out[i].append(span)
                continue
            for x, y in _outside(span, touched):
                # a sign that parts it from the base span isn't of the secret: the rest is a run of its own
                whole = y - x
                while x < y and x > span[0] and texts[i][x] in SIGNS:
                    x += 1
                while x < y and y < span[1] and texts[i][y - 1] in SIGNS:
                    y -= 1
                if (y - x >= LEAST or y - x == whole) and flat[transitions([texts[i][x:y]])].sum() > PRIOR_ODDS:
                    out[i].append((x, y))
    return out


def all_spans(column: pa.Array, ratio: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Sorted (start, kind number, end) of each text; RE2 first tells which patterns a text can match at all."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    may = [
        pc.match_substring_regex(column, r"(?i)password|passwd|secret|token|api_?key").to_pylist(),
        pc.match_substring(column, "AKIA").to_pylist(),
        pc.match_substring_regex(column, "[0-9a-f]{16}").to_pylist(),
        pc.match_substring_regex(column, "[A-Za-z0-9+/_=-]{16}").to_pylist(),
    ]
    for i in range(len(column)):
        a, b, c, d = (m[i] for m in may)
        if not (a or b or c or d):
            yield []
            continue
        text = column[i].as_py()
        spans = base_spans(text, (a, b, c))
        if d:
            spans += [(s, 3, e) for s, e in random_spans([text], ratio, [[(x, y) for x, _, y in spans]])[0]]
        yield sorted(spans)


def _scan(ratio: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                ([sum(k == n for _, k, _ in spans) for n in range(3)], *(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < top) for top in (3, 4)))
                for spans in all_spans(batch.column("text"), ratio)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
                + [pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per document."""
    ratio = train(docs) if ratio is None else ratio
    return docs.select("doc_id", "text").mapInArrow(released(_scan(ratio)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(ratio: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column("text"), all_spans(batch.column("text"), ratio), strict=True):
                text = value.as_py()
                if spans:
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            parts += [text[at:s], MASK]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def redact_secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """The same rows and columns; each span of ``text`` becomes MASK."""
    ratio = train(docs) if ratio is None else ratio
    return docs.mapInArrow(released(_redact(ratio)), docs.schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
