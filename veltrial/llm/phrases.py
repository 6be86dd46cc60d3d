"""Phrase collocations counted by slots of a minimal perfect hash.

1. Texts become blocks of about BLOCK_BYTES of one language, cut between pieces:
   a block's distinct words and its word numbers.  They are written once.
2. *Apriori-safe candidates.*  Every phrase of up to max_words words falls into
   one of 2^bits buckets; blocks send their distinct buckets with counts, packed,
   by ranges of buckets.  A bucket below min_count holds no phrase that reaches
   it; nothing else is left out.  Each heavy bucket names one block that has it,
   and that block gives the candidate's words.
3. *Counting.*  At most BLOCK_KEYS candidates at a time get a minimal perfect
   hash, which with the stored keys (languages and words) goes to all mappers.  A
   phrase's slot holds its key or not: equal ones are counted by bincount into a
   numpy array over the slots, and the mappers' arrays are summed in a tree, by
   chunks of slots.  A phrase in a heavy bucket that is not the slot's (a
   collision of bits) is counted apart, exactly, by its words.
4. *Cuts.*  Parts of a frequent phrase are as frequent, so they have slots too:
   a pass over the frequent phrases reads l and r of every cut by slot.

The driver holds the candidates of one pass (BLOCK_KEYS) and their counts, never
more.  A corpus with more candidates takes a pass over the blocks for each
BLOCK_KEYS of them.

Defined cases: null text is empty; null lang is ``und``; a piece of any length is
kept whole; repeated rows count each; an empty table gives an empty result; only
text and lang are read; equal scores and counts go by the phrase's bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veltrial.llm.common import TextBlock, U64, hash_ranges, mix64, pack_gaps, release, released, shared_checkpoint, table, task_key, text_blocks, unpack_gaps, words

MIN_COUNT, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
BITS = 40
#: Normalised text of a block; text behind one range of buckets; candidates of a pass; slots of a chunk; arrays that one task sums.
BLOCK_BYTES, RANGE_BYTES, BLOCK_KEYS, CHUNK, FAN = 4 << 20, 8 << 20, 1 << 21, 1 << 15, 32
#: Least ranges of buckets.
RANGES = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STEP = U64(0x9E3779B97F4A7C15)


def same_bytes(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_begin:] and b[b_begin:] agree for ``length`` (at least 1) bytes, by row."""
    if not len(length):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(first, length)
    return np.logical_and.reduceat(a[np.repeat(a_begin, length) + step] == b[np.repeat(b_begin, length) + step], first)


@dataclass
class Encoded:
    """Text of one language: the bytes of its distinct words, back to back, and
    the words' numbers in order, with -1 where a piece ends."""

    lang: str
    data: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts[:-1], self.starts[1:])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, places and 64-bit hashes of the phrases of n words, n from 1 to ``most``."""
        at = np.flatnonzero(self.ids >= 0)
        if not len(at):
            return
        lang = np.frombuffer(self.lang.encode() + b"\n", np.uint8)
        code = mix64(self.hashes[self.ids[at]] + hash_ranges(lang, np.zeros(1, int), np.array([len(lang)])))
        yield 1, at, code
        for n in range(2, most + 1):
            on = at + n - 1 < len(self.ids)
            at, code = at[on], code[on]
            on = self.ids[at + n - 1] >= 0
            at, code = at[on], code[on]
            code = mix64(code * _STEP + self.hashes[self.ids[at + n - 1]])
            yield n, at, code


def buckets(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> U64(64 - bits)).astype(np.int64)


def encode(lang: str, data: np.ndarray) -> Encoded:
    """``data``: UTF-8 bytes of texts, each followed by a break."""
    data = _FOLD[data]
    begin, end, code = words(TextBlock(0, 1, data, np.array([0, len(data)])), _WORD, _FOLD)
    if not len(begin):
        return Encoded(lang, data[:0], np.zeros(1, np.int64), np.zeros(0, np.int32))
    _, first, ids = np.unique(code, return_index=True, return_inverse=True)
    length = end - begin
    same = length == length[first[ids]]
    same[same] = same_bytes(data, begin[same], data, begin[first[ids[same]]], length[same])
    if not same.all():  # different words of one hash get numbers of their own
        more: dict[bytes, int] = {}
        places = list(first)
        for i in np.flatnonzero(~same):
            w = data[begin[i] : end[i]].tobytes()
            if w not in more:
                more[w] = len(places)
                places.append(i)
            ids[i] = more[w]
        first = np.array(places)
    size = length[first]
    starts = np.concatenate(([0], np.cumsum(size)))
    step = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    ended = np.cumsum(_BREAK[data])
    cut = np.flatnonzero(ended[begin[1:]] > ended[end[:-1] - 1]) + 1
    return Encoded(lang, data[np.repeat(begin[first], size) + step], starts, np.insert(ids, cut, -1).astype(np.int32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key's slot is the rank of
    its bit in the first level where it falls alone.  Other keys get any slot, or -1."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        keys, taken = keys.astype(np.uint64), 0
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            place = self._place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((size, bits, np.cumsum(ones) - ones + taken))
            taken += int(ones.sum())
            keys = keys[~alone[place]]
        self.size = taken

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + mix64(np.array([level], np.uint64))) % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            place = self._place(keys[left], level, size)
            own, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            has = (own >> bit) & U64(1) == 1
            out[left[has]] = before[place[has] >> 6] + np.bitwise_count(own[has] & ((U64(1) << bit[has]) - U64(1)))
            left = left[~has]
        return out


class Candidates:
    """Phrases with distinct buckets, by slot: stored keys (language, words) and, once known, counts."""

    def __init__(self, rows: pa.Table, bits: int):
        self.bits = bits
        bucket = rows["bucket"].to_numpy()
        self.perfect = PerfectHash(bucket)
        order = np.argsort(self.perfect.slots(bucket))
        self.bucket = bucket[order]
        lang = pc.dictionary_encode(rows["lang"]).combine_chunks()
        self.langs = {name: i for i, name in enumerate(lang.dictionary.to_pylist())}
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[order]
        # the phrases' words, a slice at a time: all of them at once would be several times the table
        distinct = pa.array([], pa.large_string())
        lengths = [np.zeros(0, np.int8)]
        for phrases in self._slices(rows):
            distinct = pa.concat_arrays([distinct, pc.unique(phrases.flatten())]).unique()
            lengths.append(phrases.value_lengths().to_numpy(zero_copy_only=False).astype(np.int8))
        self.length = np.concatenate(lengths)
        self.words = np.full((len(bucket), int(self.length.max(initial=1))), -1, np.int32)
        lo = 0
        for phrases, length in zip(self._slices(rows), lengths[1:], strict=True):
            length = length.astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            self.words[lo + row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = pc.index_in(phrases.flatten(), value_set=distinct).to_numpy(zero_copy_only=False)
            lo += len(length)
        self.length, self.words = self.length[order], self.words[order]
        block = next(text_blocks(distinct, 1 << 62), TextBlock(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.data, self.starts = block.data.copy(), block.starts.copy()
        code, first = np.unique(hash_ranges(self.data, self.starts[:-1], self.starts[1:]), return_index=True)
        self.by_word = PerfectHash(code)
        self.word_at = np.empty(len(code), np.int64)
        self.word_at[self.by_word.slots(code)] = first  # a second word of one hash is never found: its phrases count as collisions
        self.counts = rows["f"].to_numpy()[order] if "f" in rows.column_names else None
        release()

    @staticmethod
    def _slices(rows: pa.Table) -> Iterator[pa.Array]:
        for lo in range(0, rows.num_rows, 1 << 17):
            phrases = rows["phrase"].slice(lo, 1 << 17).combine_chunks().cast(pa.large_string())
            yield pc.split_pattern(phrases, " ")

    def _own_words(self, text: Encoded) -> np.ndarray:
        """This table's number of each of a text's distinct words, -1 where it has none."""
        out = np.full(len(text.starts) - 1, -1, np.int64)
        if not len(self.word_at) or not len(out):
            return out
        slot = self.by_word.slots(text.hashes)
        has = np.flatnonzero(slot >= 0)
        own = self.word_at[slot[has]]
        length = np.diff(text.starts)[has]
        fits = length == self.starts[own + 1] - self.starts[own]
        has, own, length = has[fits], own[fits], length[fits]
        same = same_bytes(text.data, text.starts[has], self.data, self.starts[own], length)
        out[has[same]] = own[same]
        return out

    def places(self, text: Encoded, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """n, places of phrases of n words in heavy buckets, their slots, and whether the stored key is theirs."""
        own = np.append(self._own_words(text), -1)[text.ids]
        lang = self.langs.get(text.lang, -1)
        for n, at, code in text.grams(most):
            bucket = buckets(code, self.bits)
            slot = self.perfect.slots(bucket)
            heavy = slot >= 0
            heavy[heavy] = self.bucket[slot[heavy]] == bucket[heavy]
            at, slot = at[heavy], slot[heavy]
            same = (self.length[slot] == n) & (self.lang[slot] == lang)
            for i in range(min(n, self.words.shape[1])):
                same &= own[at + i] == self.words[slot, i]
            yield n, at, slot, same


def _packed(text: Encoded) -> dict:
    data, ids = pa.py_buffer(text.data), pa.py_buffer(text.ids)
    return {"lang": text.lang, "data": pa.compress(data, "zstd", asbytes=True), "lengths": pa.compress(pa.py_buffer(np.diff(text.starts).astype(np.int32)), "zstd", asbytes=True), "ids": pa.compress(ids, "zstd", asbytes=True), "n_data": data.size, "n_words": len(text.starts) - 1, "n_ids": len(text.ids)}


BLOCKS = "block long, part int, lang string, data binary, lengths binary, ids binary, n_data long, n_words long, n_ids long, n long, size long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    waiting: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        data = np.concatenate(waiting.pop(lang))
        held.pop(lang)
        text = encode(lang, data)
        if len(text.ids):
            row = _packed(text) | {"block": task_key() + made, "part": part, "n": int((text.ids >= 0).sum()), "size": len(data)}
            made += 1
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

    for batch in batches:
        langs = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for own in text_blocks(batch.column(1).filter(pa.array(code == i)), BLOCK_BYTES, b"\n"):
                for piece in _pieces(own.data):
                    waiting.setdefault(lang, []).append(piece.copy())
                    held[lang] = held.get(lang, 0) + len(piece)
                    if held[lang] >= BLOCK_BYTES:
                        yield from flush(lang)
        while sum(held.values()) > 4 * BLOCK_BYTES:
            yield from flush(max(held, key=held.get))
    for lang in list(waiting):
        yield from flush(lang)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("lang", pa.string()), ("data", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), *((c, pa.int64()) for c in ("n_data", "n_words", "n_ids", "n", "size"))])


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Data in parts of about BLOCK_BYTES that end with a break (no piece is cut)."""
    lo = 0
    while len(data) - lo > 2 * BLOCK_BYTES:
        after = np.flatnonzero(_BREAK[data[lo + BLOCK_BYTES : lo + 2 * BLOCK_BYTES]])
        if not len(after):
            after = np.flatnonzero(_BREAK[data[lo + 2 * BLOCK_BYTES :]]) + BLOCK_BYTES
        hi = lo + BLOCK_BYTES + int(after[0]) + 1
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Encoded]]:
    """part, block and text of each row of BLOCKS."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            lengths = np.frombuffer(pa.decompress(r["lengths"], 4 * r["n_words"], "zstd"), np.int32)
            data = np.frombuffer(pa.decompress(r["data"], r["n_data"], "zstd"), np.uint8)
            ids = np.frombuffer(pa.decompress(r["ids"], 4 * r["n_ids"], "zstd"), np.int32)
            yield r["part"], r["block"], Encoded(r["lang"], data, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), ids)


def _bucket_counts(ranges: int, min_count: int, most: int, bits: int) -> Callable:
    edges = np.array([(r << bits) // ranges for r in range(ranges + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, text in _texts(batches):
            found, count = np.unique(np.concatenate([buckets(code, bits) for _, _, code in text.grams(most)]), return_counts=True)
            cut = np.searchsorted(found, edges)
            gap = np.diff(found, prepend=0)
            has = np.flatnonzero(cut[1:] > cut[:-1])
            gap[cut[has]] = found[cut[has]] - edges[has]
            gaps, at = pack_gaps(gap)
            counts, to = pack_gaps(np.minimum(count, min_count))
            at, to = np.append(at, len(gaps)), np.append(to, len(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(has, pa.int64()), pa.array(np.full(len(has), block), pa.int64()), pa.array([gaps[at[cut[r]] : at[cut[r + 1]]].tobytes() for r in has], pa.binary()), pa.array([counts[to[cut[r]] : to[cut[r + 1]]].tobytes() for r in has], pa.binary())],
                names=["range", "block", "gaps", "counts"],
            )

    return run


def _heavy(ranges: int, min_count: int, bits: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        own = [np.cumsum(unpack_gaps(np.frombuffer(g, np.uint8))) for g in pdf["gaps"]]
        count = np.concatenate([unpack_gaps(np.frombuffer(c, np.uint8)) for c in pdf["counts"]])
        block = np.repeat(pdf["block"].to_numpy(), [len(o) for o in own])
        bucket = np.concatenate(own)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        heavy = first[np.add.reduceat(count[order], first) >= min_count]
        return pd.DataFrame({"bucket": bucket[heavy] + (int(key[0]) << bits) // ranges, "block": block[order[heavy]]})

    return run


KEYS = "bucket long, lang string, k int, phrase string"


def _keys(heavy, most: int, bits: int) -> Callable:
    """Names the phrase of each heavy bucket that was left to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_buckets, all_blocks = heavy.value
        for _, block, text in _texts(batches):
            own = all_buckets[all_blocks == block]
            if not len(own):
                continue
            left = np.ones(len(own), bool)
            rows = []
            for n, at, code in text.grams(most):
                bucket = buckets(code, bits)
                place = np.minimum(np.searchsorted(own, bucket), len(own) - 1)
                hit = np.flatnonzero((own[place] == bucket) & left[place])
                named, first = np.unique(place[hit], return_index=True)
                left[named] = False
                for b, i in zip(named, at[hit[first]], strict=True):
                    rows.append((int(own[b]), text.lang, n, b" ".join(text.word(w) for w in text.ids[i : i + n]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "lang", "k", "phrase"]).cast(pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string())]))

    return run


COUNTS = "chunk int, part int, slots binary, counts binary, lang string, k int, phrase string, f long"
_COUNT_SCHEMA = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _chunk(counts: np.ndarray) -> dict:
    slot = np.flatnonzero(counts)
    return {"slots": pack_gaps(np.diff(slot, prepend=0))[0].tobytes(), "counts": pack_gaps(counts[slot])[0].tobytes()}


def _unchunk(slots: bytes, counts: bytes, into: np.ndarray) -> None:
    into[np.cumsum(unpack_gaps(np.frombuffer(slots, np.uint8)))] += unpack_gaps(np.frombuffer(counts, np.uint8))


def _count(candidates, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Candidates = candidates.value
        total, part = np.zeros(len(own.bucket), np.int64), 0
        for part, _, text in _texts(batches):
            for n, at, slot, same in own.places(text, most):
                total += np.bincount(slot[same], minlength=len(total))
                if not same.all():
                    other, f = np.unique(text.ids[at[~same][:, None] + np.arange(n)], axis=0, return_counts=True)
                    rows = [{"chunk": -1, "part": part, "lang": text.lang, "k": n, "phrase": b" ".join(text.word(w) for w in p).decode(), "f": int(c)} for p, c in zip(other, f, strict=True)]
                    yield pa.RecordBatch.from_pylist(rows, schema=_COUNT_SCHEMA)
        for lo in range(0, len(total), CHUNK):
            if total[lo : lo + CHUNK].any():
                yield pa.RecordBatch.from_pylist([{"chunk": lo // CHUNK, "part": part} | _chunk(total[lo : lo + CHUNK])], schema=_COUNT_SCHEMA)

    return run


def _sum_chunks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for s, c in zip(pdf["slots"], pdf["counts"], strict=True):
        _unchunk(s, c, total)
    return pd.DataFrame([{"chunk": key[0], "part": key[1]} | _chunk(total)])


def _cuts(candidates, most: int, schema: pa.Schema) -> Callable:
    """Fills the counts of cuts' parts whose slots are among these candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Candidates = candidates.value
        for batch in batches:
            k = batch.column("k").to_numpy()
            parts = np.stack(batch.column("parts").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 2 * most - 2), np.int64)
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            parts = parts.copy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(code == i)
                block = next(text_blocks(batch.column("phrase").take(pa.array(at)), 1 << 62, b"\n"))
                text = encode(lang, block.data)
                begin = np.cumsum(k[at] + 1) - k[at] - 1
                for n, place, slot, same in own.places(text, most - 1):
                    f = np.full(len(text.ids) + 1, -1, np.int64)
                    f[place[same]] = own.counts[slot[same]]
                    for cut in range(1, most):
                        for side, start, size in ((0, begin, np.full(len(at), cut)), (1, begin + cut, k[at] - cut)):
                            fits = np.flatnonzero((size == n) & (cut < k[at]))
                            value = f[start[fits]]
                            known = value >= 0
                            parts[at[fits[known]], 2 * cut - 2 + side] = value[known]
            columns = {c: batch.column(c) for c in batch.schema.names} | {"parts": pa.array(list(parts), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)

    return run


FREQUENT = "bucket long, lang string, k int, phrase string, f long, layer int"
SCORED = "lang string, phrase string, k int, a long, l long, r long, score long"


def scores(a: np.ndarray, k: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, r and floor(1000000 * a^2 / (l * r)) of the lowest-scoring cut, the smallest of equal ones; exact at any size."""
    best = np.full(len(a), -1, np.int64)
    l, r = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    wide = a.astype(object)
    top = wide * wide * 1_000_000
    for cut in range(1, parts.shape[1] // 2 + 1):
        has = np.flatnonzero(k > cut)
        left, right = parts[has, 2 * cut - 2], parts[has, 2 * cut - 1]
        value = (top[has] // (left.astype(object) * right.astype(object))).astype(np.int64)
        less = (best[has] < 0) | (value < best[has])
        has = has[less]
        best[has], l[has], r[has] = value[less], left[less], right[less]
    return l, r, best


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, k = batch.column("a").to_numpy(), batch.column("k").to_numpy()
            l, r, score = scores(a, k, np.stack(batch.column("parts").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), batch.column("k"), *map(pa.array, (a, l, r, score))], names=["lang", "phrase", "k", "a", "l", "r", "score"])


class PhraseMiner:
    def __init__(self, docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_keys: int = BLOCK_KEYS, bits: int = BITS):
        self.spark, self.min_count, self.most, self.block_keys, self.bits = docs.sparkSession, min_count, max_words, block_keys, bits
        self.blocks = shared_checkpoint(docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).mapInArrow(released(_blocks), BLOCKS))
        sums = self.blocks.agg(F.sum("size"), F.max("part")).first()
        self.size, self.parts = sums[0] or 0, sums[1] or 0

    def word_counts(self) -> DataFrame:
        """lang, n."""
        return self.blocks.groupBy("lang").agg(F.sum("n").alias("n"))

    def _ranges(self, rows: DataFrame, bucket: str = "bucket") -> Iterator[DataFrame]:
        """Rows with distinct buckets in parts of at most about block_keys."""
        n = rows.count()
        parts = -(-n // self.block_keys)
        for i in range(parts):
            yield rows.where(F.col(bucket).between((i << self.bits) // parts, ((i + 1) << self.bits) // parts - 1))

    def frequent(self) -> DataFrame:
        """Every phrase of up to max_words words with min_count occurrences: FREQUENT.
        Layer 0 has distinct buckets, the others are what collided with them."""
        ranges = max(RANGES, -(-self.size // RANGE_BYTES))
        sent = self.blocks.mapInArrow(released(_bucket_counts(ranges, self.min_count, self.most, self.bits)), "range long, block long, gaps binary, counts binary")
        heavy = shared_checkpoint(sent.groupBy("range").applyInPandas(_heavy(ranges, self.min_count, self.bits), "bucket long, block long"))
        found = None
        for part in self._ranges(heavy):
            own = self._counted(part)
            found = own if found is None else found.union(own)
        if found is None:
            return self.spark.createDataFrame([], FREQUENT)
        return found

    def _counted(self, heavy: DataFrame) -> DataFrame:
        sc = self.spark.sparkContext
        named = heavy.toArrow().sort_by("bucket")
        at = sc.broadcast((named["bucket"].to_numpy(), named["block"].to_numpy()))
        keys = shared_checkpoint(self.blocks.mapInArrow(released(_keys(at, self.most, self.bits)), KEYS))
        at.destroy()
        del named
        candidates = Candidates(keys.toArrow(), self.bits)
        sent = sc.broadcast(candidates)
        counted = shared_checkpoint(self.blocks.mapInArrow(released(_count(sent, self.most)), COUNTS))
        sent.destroy()
        chunks, last = counted.where("chunk >= 0").select("chunk", "part", "slots", "counts"), self.parts
        while last:
            chunks = chunks.groupBy("chunk", F.expr(f"cast(part div {FAN} as int)").alias("part")).applyInPandas(_sum_chunks, "chunk int, part int, slots binary, counts binary")
            last //= FAN
        total = np.zeros(len(candidates.bucket), np.int64)
        for r in chunks.collect():  # an array of counts over the slots of this pass
            _unchunk(r["slots"], r["counts"], total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK])
        own = sc.broadcast((candidates.perfect, total))
        del candidates
        release()
        most = self.min_count

        def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            perfect, counts = own.value
            for batch in batches:
                bucket = batch.column("bucket").to_numpy()
                f = counts[perfect.slots(bucket)] if len(bucket) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], names=[*batch.schema.names, "f"]).filter(pa.array(f >= most))

        found = shared_checkpoint(keys.mapInArrow(with_counts, KEYS + ", f long").withColumn("layer", F.lit(0)))
        own.unpersist()
        others = counted.where("chunk < 0").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= self.min_count)
        others = others.mapInArrow(_with_bucket(self.bits), "lang string, k int, phrase string, f long, bucket long")
        layer = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "phrase"))
        return found.union(others.select("bucket", "lang", "k", "phrase", "f", layer.alias("layer")))

    def candidates(self) -> DataFrame:
        """SCORED: frequent phrases of two and more words with their lowest-scoring cut."""
        frequent = shared_checkpoint(self.frequent())
        empty = F.array_repeat(F.lit(-1).cast("long"), 2 * self.most - 2)
        rows = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), empty.alias("parts"))
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("a", pa.int64()), ("parts", pa.list_(pa.int64()))])
        for layer in range((frequent.agg(F.max("layer")).first()[0] or 0) + 1):
            for part in self._ranges(frequent.where(F.col("layer") == layer)):
                own = self.spark.sparkContext.broadcast(Candidates(part.select("bucket", "lang", "phrase", "f").toArrow(), self.bits))
                rows = shared_checkpoint(rows.mapInArrow(released(_cuts(own, self.most, schema)), "lang string, phrase string, k int, a long, parts array<long>"))
                own.unpersist()
        return rows.mapInArrow(_scored, SCORED)


def _with_bucket(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.zeros(batch.num_rows, np.int64)
            for i, (lang, phrase, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "k")), strict=True)):
                text = encode(lang, np.frombuffer(phrase.encode() + b"\n", np.uint8))
                bucket[i] = next(buckets(code, bits)[0] for n, _, code in text.grams(k) if n == k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "k", "phrase", "f")), pa.array(bucket)], names=["lang", "k", "phrase", "f", "bucket"])

    return run


def uncovered(scored: DataFrame, max_words: int, covered: int = COVERED) -> DataFrame:
    """Drops candidates inside a longer one that has at least ``covered`` per cent of their occurrences."""
    spans = [(i, k) for k in range(2, max_words) for i in range(1, max_words - k + 2)]
    if not spans:
        return scored
    split = F.split("phrase", " ")
    inner = F.array(*[F.when(F.col("k") >= F.greatest(F.lit(i + k - 1), F.lit(k + 1)), F.array_join(F.slice(split, i, k), " ")) for i, k in spans])
    longer = scored.select("lang", F.explode(F.array_distinct(F.array_compact(inner))).alias("phrase"), F.col("a").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("_f").isNull() | (100 * F.col("_f") < covered * F.col("a"))).drop("_f")


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered: int = COVERED, **limits: int) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    miner = PhraseMiner(docs, text_column, lang_column, min_count, max_words, **limits)
    kept = uncovered(miner.candidates(), max_words, covered)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(miner.word_counts(), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))
  GROUP BY ALL
), n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase
), kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
