"""Language identification of whole, possibly mixed-language texts.

Each run of letters is a word.  The script of its first letter narrows the
candidate languages to those that the training texts write in that script; over
these, hashed character trigrams give the word a log-likelihood for each
language.  Viterbi over a document's words, with a penalty for each change of
language, labels spans; the document gets the language of most of its letters.

The trigram tables are counted on a bounded sample (SAMPLE_DOCS distinct labelled
rows, chosen by a hash of id and text) and hold BUCKETS numbers a language.

Defined cases: null text and text without a letter are ``und`` with score 0;
rows without a label train nothing; no labelled row at all: every text is
``und``; repeated rows are rows of their own; empty table: empty result; other
columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import U64, mix64, released, sampled, table, text_blocks

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
#: Natural-log cost of changing the language between two words.
SWITCH = 12.0
#: A word tells at most this much for one language over another.
WORD_LIMIT = 8.0
UNKNOWN = "und"

# First code points of script ranges, in order; each runs to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_KINDS = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Is a code point a letter; its lower case where that is one code point."""
    if not _TABLES:
        _TABLES["letter"] = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        _TABLES["lower"] = np.fromiter((ord(x) if len(x := chr(p).lower()) == 1 else p for p in range(0x110000)), np.uint32, 0x110000)
    return _TABLES["letter"], _TABLES["lower"]


@dataclass
class Words:
    """Words of some texts: offsets in ``points``, the text of each, and the distinct words."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    inverse: np.ndarray
    script: np.ndarray  # of each distinct word
    grams: np.ndarray  # buckets of the distinct words' trigrams
    first: np.ndarray  # where each distinct word's trigrams begin


def find_words(texts: list[str]) -> Words:
    letter, lower = _letters()
    points = lower[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = letter[points]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[0::2], edge[1::2]
    text_ends = np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)
    row = np.searchsorted(text_ends, begin, "right")
    # trigrams of the word with one border on each side: one for each of its letters
    wide = np.where(inside, points, 0).astype(np.uint64)
    before, after = np.concatenate(([0], wide[:-1])).astype(np.uint64), np.append(wide[1:], 0).astype(np.uint64)
    gram = mix64(before * U64(0x9E3779B97F4A7C15) + wide * U64(0xC2B2AE3D27D4EB4F) + after * U64(0x165667B19E3779F9))
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(points, begin, end, row, none, none, none, none)
    length = end - begin
    flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    place = flat - np.repeat(begin, length)
    own = mix64(gram[flat] + place.astype(np.uint64))
    key = np.add.reduceat(own, np.cumsum(length) - length)
    _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
    size = length[where]
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(begin[where], size)
    script = _SCRIPT_KINDS[np.searchsorted(_SCRIPT_STARTS, points[begin[where]], "right") - 1]
    return Words(points, begin, end, row, inverse, script, (gram[at] & U64(BUCKETS - 1)).astype(np.int64), first)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages)
    writes: np.ndarray  # (scripts, languages): does the language use the script


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(distinct words, languages): log-likelihoods, the best at 0, none below -WORD_LIMIT."""
    score = np.add.reduceat(model.logp[words.grams], words.first, axis=0)
    allowed = model.writes[words.script]
    allowed[~allowed.any(1)] = True
    score = np.where(allowed, score, -np.inf)
    score -= score.max(1, keepdims=True)
    return np.maximum(score, -WORD_LIMIT)


def viterbi(score: np.ndarray, row: np.ndarray, n_rows: int, switch: float = SWITCH) -> np.ndarray:
    """Language number of each word; all documents of the block step together."""
    count = np.bincount(row, minlength=n_rows)
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    count, start = count[order], start[order]
    n_langs = score.shape[1]
    stay = np.empty(score.shape, bool)
    source = np.empty(len(score), np.int16)
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), "left")  # documents longer than the step
    value = np.zeros((len(count), n_langs))
    for t in range(steps):
        a = active[t]
        at = start[:a] + t
        v = value[:a]
        top = v.argmax(1)
        best = v[np.arange(a), top][:, None] - switch
        stay[at] = v >= best
        source[at] = top
        np.maximum(v, best, out=v)
        v += score[at]
    path = np.empty(len(score), np.int16)
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        path[at] = state[:a]
        keep = stay[at, state[:a]]
        state[:a] = np.where(keep, state[:a], source[at])
    return path


def label_words(texts: list[str], model: Model) -> tuple[Words, np.ndarray]:
    words = find_words(texts)
    if not len(words.begin):
        return words, np.zeros(0, np.int16)
    return words, viterbi(word_scores(words, model)[words.inverse], words.row, len(texts))


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, share of letters in it, and number of spans, of each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    words, path = label_words(texts, model)
    letters = np.bincount(words.row * len(model.languages) + path, weights=words.end - words.begin, minlength=len(texts) * len(model.languages)).reshape(len(texts), -1)
    total = letters.sum(1)
    best = letters.argmax(1)
    change = np.ones(len(path), bool)
    change[1:] = (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])
    return (
        [model.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)],
        np.divide(letters.max(1), total, out=np.zeros(len(texts)), where=total > 0),
        np.bincount(words.row[change], minlength=len(texts)),
    )


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of each stretch of words in one language."""
    words, path = label_words([text], model)
    out: list[tuple[int, int, str]] = []
    for b, e, p in zip(words.begin.tolist(), words.end.tolist(), path.tolist(), strict=True):
        if out and out[-1][2] == model.languages[p]:
            out[-1] = (out[-1][0], e, out[-1][2])
        else:
            out.append((b, e, model.languages[p]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        by: dict[str, list[str]] = {}
        for t, x in zip(texts, langs, strict=True):
            by.setdefault(x, []).append(t or "")
        for x, own in by.items():
            for i in range(0, len(own), 256):
                w = find_words(own[i : i + 256])
                if not len(w.begin):
                    continue
                times = np.bincount(w.inverse)
                size = np.diff(np.append(w.first, len(w.grams)))
                grams[x] = grams.get(x, 0) + np.bincount(w.grams, weights=np.repeat(times, size), minlength=BUCKETS)
                scripts[x] = scripts.get(x, 0) + np.bincount(w.script, weights=times, minlength=len(SCRIPT_NAMES))
    for x, n in grams.items():
        for kind, c in ((0, n), (1, scripts[x])):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at].astype(np.int64))], names=["lang", "kind", "at", "n"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """labelled: doc_id, text, lang (non-null).  The counts that reach the
    driver are at most BUCKETS + len(SCRIPT_NAMES) a language."""
    sample = sampled(labelled.select("doc_id", "text", "lang"), sample_docs, ("doc_id", "text", "lang"), once=False).select("text", "lang")
    rows = sample.mapInArrow(released(_count), "lang string, kind int, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    logp = np.zeros((BUCKETS, len(languages)), np.float32)
    writes = np.zeros((len(SCRIPT_NAMES), len(languages)), bool)
    for j, x in enumerate(languages):
        own = rows[rows["lang"] == x]
        g, s = own[own["kind"] == 0], own[own["kind"] == 1]
        n = np.full(BUCKETS, 0.1)
        n[g["at"].to_numpy()] += g["n"].to_numpy()
        logp[:, j] = np.log(n / n.sum())
        writes[s["at"].to_numpy(), j] = s["n"].to_numpy() >= 0.001 * s["n"].sum()
    return Model(languages, logp, writes)


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text"), 1 << 20):
                part = batch.slice(block.lo, block.hi - block.lo)
                lang, score, n = predict([t or "" for t in part.column("text").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(n)], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    return run


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def model_of(docs: DataFrame) -> Model:
    """Learns from the labelled rows that aren't held out."""
    return train(docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull()))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: one row per document."""
    model = model or model_of(docs)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(released(_predict(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_spans long")


def _keep(model: Model, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text"), 1 << 20):
                part = batch.slice(block.lo, block.hi - block.lo)
                lang, score, _ = predict([t or "" for t in part.column("text").to_pylist()], model)
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)]))

    return run


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.4) -> DataFrame:
    """Rows, all columns, whose language is known with a score of at least ``least``."""
    return docs.mapInArrow(released(_keep(model or model_of(docs), least)), docs.schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
