"""Suffix-array dedup: remove bytes of 50-byte strings seen in an earlier document.

A distributed merge sort of suffixes.  Which suffixes: every 50-byte string has
an anchor, the place in it whose 24-byte string has the least hash, so equal
strings have their anchors at equal places, and sorting the suffixes at anchors
(about one place in 14) settles all strings.

1. Buckets of documents send the hashes of their anchors' 24-byte strings,
   packed, to ranges of hashes; those that several documents have come back.
2. A bucket sorts the suffixes at the anchors that are left.  A suffix's key is
   the text from the anchor to the end of the anchor's last string, then the
   text before it, backwards.  The sorted run, each key once with the least id of
   the bucket that has it, is cut at sampled splitters, front-coded, and exchanged.
3. Each part merges its runs with a loser tree whose nodes keep the length of
   the prefix known to be common with the last key put out: different lengths
   decide without looking at the keys, equal ones go on comparing behind them.
4. Equal keys are repeats in all their strings.  Keys that share only the
   anchor's 24 bytes are opened into their 50-byte strings, compared by these.
   A bucket gets back the keys for which an earlier document is elsewhere: the
   least id, and which of the strings that id's own suffix repeats.  It sorts its
   suffixes again and knows the rest itself.

The texts are exchanged once, by bucket; all steps that need them read that
exchange.  A suffix that all documents have is one key a bucket.

Defined cases: null text is empty; a text under 50 bytes keeps all; rows with
equal ids are one document in the comparison and keep their own result rows; a
null doc_id is neither smaller nor larger than any other, so its text stays
whole and removes nothing; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import U64, mix64, pack_ascending, table, unpack_ascending

LENGTH = 50
#: Bytes hashed at a place, and places (hence strings of an anchor) in a 50-byte string.
CORE = 24
PLACES = LENGTH - CORE + 1
WIDTH = LENGTH + PLACES  # bytes of a key: text from the anchor, text before it, its length
#: Bytes of a bucket, and the buckets that a smaller table is cut into (of PASS bytes or more).
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
PASS = 1 << 17
SAMPLE_DOCS = 2000
NO_ID = np.iinfo(np.int64).max
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie back to back: (place, first string, last string) of each, ascending."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    valid = np.ones(windows, bool)
    for end in starts[1:-1].tolist():  # strings that would run into the next text
        valid[max(0, end - LENGTH + 1) : end] = False
    eight = _words8(data)
    at, first, last = [], [], []
    for lo in range(0, windows, PASS):
        hi = min(windows, lo + PASS)
        m = hi - lo + PLACES - 1
        h = eight[lo : lo + m] * _A
        h += eight[lo + 8 : lo + 8 + m] * _B
        h += eight[lo + 16 : lo + 16 + m] * _C
        h ^= h >> U64(29)
        h *= _B
        h &= U64(0xFFFFFFFFFF000000)
        h |= np.arange(m, dtype=np.uint64)  # the least hash, the leftmost of equals
        width = 1
        while 2 * width <= PLACES:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < PLACES:
            h = np.minimum(h[: -(PLACES - width)], h[PLACES - width :])
        p = np.flatnonzero(valid[lo:hi])
        if not len(p):
            continue
        a = (h[p] & U64(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.diff(a, prepend=-1))
        at.append(a[edge] + lo)
        first.append(p[edge] + lo)
        last.append(np.append(p[edge[1:] - 1], p[-1]) + lo)
    if not at:
        return (np.zeros(0, np.int64),) * 3
    at, first, last = np.concatenate(at), np.concatenate(first), np.concatenate(last)
    edge = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor cut by a pass
    return at[edge], first[edge], last[np.append(edge[1:] - 1, len(at) - 1)]


def core_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    eight = _words8(data)
    return mix64(mix64(mix64(eight[at] + _A) + eight[at + 8]) + eight[at + 16])


class Bucket:
    """Texts of one bucket, ordered by id."""

    def __init__(self, group: pa.Table):
        ids = group.column("doc_id").combine_chunks() if group.num_rows else pa.array([], pa.int64())
        text = group.column("text").cast(pa.large_string()).combine_chunks().cast(pa.large_binary()) if group.num_rows else pa.array([], pa.large_binary())
        order = pc.sort_indices(pa.table({"i": ids, "t": text}), [("i", "ascending"), ("t", "ascending")])
        ids, self.text = ids.take(order), text.take(order)
        self.doc_ids = ids
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(self.text.buffers()[1], np.int64)[: len(self.text) + 1] if len(self.text) else np.zeros(1, np.int64)
        raw = self.text.buffers()[2] if len(self.text) else None
        self.starts = offsets - offsets[0]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, first string, last string, text) without texts that have no id."""
        at, first, last = anchors(self.data, self.starts)
        row = np.searchsorted(self.starts, at, "right") - 1
        named = self.ids[row] != NO_ID
        return at[named], first[named], last[named], row[named]


CORES = "bucket int, range int, n long, data binary"
_CORES = pa.schema([("bucket", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)


def _cores(bits: int) -> Callable:
    """Distinct core hashes of a bucket by range: 40 bits of each, and whether several of its documents have it."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = Bucket(group)
        at, _, _, row = bucket.anchors()
        if not len(at):
            return _CORES.empty_table()
        h = core_hashes(bucket.data, at)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], bucket.ids[row[order]]
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.maximum.reduceat(owner, edge) != np.minimum.reduceat(owner, edge)
        h = h[edge]
        ranges = (h >> U64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(ranges, prepend=-1))
        rows = []
        for a, b in zip(cut, [*cut, len(h)][1:], strict=True):
            t = (h[a:b] >> U64(64 - bits - 40)) & U64((1 << 40) - 1)
            rows.append((key[0].as_py(), int(ranges[a]), int(b - a), np.packbits(several[a:b]).tobytes() + pack_ascending(t)))
        return _table(rows, _CORES)

    return run


def _repeated(key: tuple, group: pa.Table) -> pa.Table:
    """One range of hashes: for each bucket, its hashes that several documents have (40 bits each)."""
    token, bucket, several = [], [], []
    names = group.column("bucket").to_pylist()
    for k, (n, data) in enumerate(zip(group.column("n").to_pylist(), group.column("data").to_pylist(), strict=True)):
        cut = -(-n // 8)
        token.append(unpack_ascending(data[cut:]))
        several.append(np.unpackbits(np.frombuffer(data, np.uint8, cut), count=n).astype(bool))
        bucket.append(np.full(n, k, np.int32))
    token, bucket, several = np.concatenate(token), np.concatenate(bucket), np.concatenate(several)
    order = np.argsort(token, kind="stable")
    token, bucket, several = token[order], bucket[order], several[order]
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(edge, len(token)))
    good = np.repeat((size > 1) | (np.logical_or.reduceat(several, edge) if len(edge) else False), size)
    token, bucket = token[good], bucket[good]
    order = np.argsort(bucket, kind="stable")
    token, bucket = token[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = [
        (names[bucket[a]], key[0].as_py(), int(b - a), pack_ascending(token[a:b]))
        for a, b in zip(cut, [*cut, len(token)][1:], strict=True)
    ]
    return _table(rows, _CORES)


def _hashes_of(group: pa.Table) -> np.ndarray:
    """range << 40 | hash, ascending."""
    out = [np.zeros(0, np.uint64)]
    for r, data in zip(group.column("range").to_pylist(), group.column("data").to_pylist(), strict=True):
        if r >= 0:
            out.append(unpack_ascending(data).astype(np.uint64) | (U64(r) << U64(40)))
    return np.sort(np.concatenate(out))


def suffix_keys(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as rows of WIDTH bytes (zero behind their end) and their lengths."""
    left, right = at - first, last + LENGTH - at
    keys = np.zeros((len(at), WIDTH), np.uint8)
    column = np.arange(WIDTH)
    for lo in range(0, len(at), 8192):
        a, x, r = at[lo : lo + 8192, None], left[lo : lo + 8192, None], right[lo : lo + 8192, None]
        source = np.where(column < r, a + column, a - 1 - (column - r))
        part = data[np.clip(source, 0, len(data) - 1)]
        keys[lo : lo + 8192] = np.where(column < r + x, part, np.where(column == r + x, x, 0))
    return keys, left + right + 1


RUNS = "part int, bucket int, n long, data binary"
_RUNS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def front_code(keys: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted keys as common prefix lengths with the key before, and what follows."""
    common = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH)
        common[1:] = np.minimum(common[1:], np.minimum(length[1:], length[:-1]))
    column = np.arange(WIDTH)
    return common, keys[(column >= common[:, None]) & (column < length[:, None])].tobytes()


class Suffixes:
    """The suffixes of a bucket at repeated anchors, in order: ``first`` string
    and text (``row``) of each; ``edge`` is where a new key begins, ``least`` the
    smallest id that has it, and ``part`` where it is merged."""

    def __init__(self, bucket: Bucket, known: pa.Table, bits: int, splitters: np.ndarray):
        wanted = _hashes_of(known)
        at, first, last, row = bucket.anchors()
        if len(wanted):
            h = core_hashes(bucket.data, at) >> U64(64 - bits - 40)
            here = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
        else:
            here = np.zeros(len(at), bool)
        at, first, last, row = at[here], first[here], last[here], row[here]
        keys, length = suffix_keys(bucket.data, at, first, last)
        order = np.argsort(length, kind="stable")  # a key before those that only add zero bytes to it
        order = order[np.argsort(keys[order].view(f"S{WIDTH}").ravel(), kind="stable")]
        keys, length, self.row, self.first = keys[order], length[order], row[order], first[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(1) | (length[1:] != length[:-1])
        self.edge = np.flatnonzero(fresh)
        self.ids = bucket.ids[self.row]
        self.least = np.minimum.reduceat(self.ids, self.edge) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.length = keys[self.edge], length[self.edge]
        self.part = np.searchsorted(splitters, np.ascontiguousarray(self.keys[:, :CORE]).view(f"S{CORE}").ravel(), "right") if len(keys) else np.zeros(0, np.int64)


def _runs(bits: int, splitters: np.ndarray) -> Callable:
    """A bucket's sorted, front-coded run for each part.

    Of a run: distinct keys (prefix length, rest length: a byte each), the least
    id of each, then all rests."""

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows or not known.num_rows:
            return _RUNS.empty_table()
        s = Suffixes(Bucket(texts), known, bits, splitters)
        cut = np.flatnonzero(np.diff(s.part, prepend=-1))
        rows = []
        for a, b in zip(cut, [*cut, len(s.edge)][1:], strict=True):
            common, rest = front_code(s.keys[a:b], s.length[a:b])
            rows.append((int(s.part[a]), key[0].as_py(), int(b - a), common.astype(np.uint8).tobytes() + (s.length[a:b] - common).astype(np.uint8).tobytes() + s.least[a:b].astype("<i8").tobytes() + rest))
        return _table(rows, _RUNS)

    return run


class Run:
    """A front-coded run, read key by key."""

    __slots__ = ("common", "rest_length", "blob", "n", "at", "offset", "key", "least")

    def __init__(self, n: int, data: bytes):
        self.n, self.at, self.offset, self.key = n, -1, 10 * n, b""
        self.common, self.rest_length, self.blob = data[:n], data[n : 2 * n], data
        self.least = np.frombuffer(data, "<i8", n, 2 * n)

    def step(self) -> int:
        """Go to the next key; its common prefix length with the one before, -1 at the end."""
        self.at = at = self.at + 1
        if at >= self.n:
            return -1
        common, o = self.common[at], self.offset
        self.offset = o + self.rest_length[at]
        self.key = self.key[:common] + self.blob[o : self.offset]
        return common


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    most = min(len(a), len(b))
    step = 8
    while at < most and a[at : at + step] == b[at : at + step]:
        at += step
    if at >= most:
        return most
    while at < most and a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """Merge runs: (run number, common prefix length with the key put out before), the run standing at its key.

    A node holds its loser and the loser's common prefix with the last key that
    passed the node.  The contestant with the longer one is smaller, as both are
    not smaller than that key; only at equal lengths are keys compared, from
    there on."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    known = [r.step() for r in runs] + [-1] * (leaves - len(runs))  # -1: at its end, loses always
    loser = [0] * leaves
    winners = [0] * leaves + list(range(leaves))

    def lost(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's known prefix is set."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = runs[a].key, runs[b].key
        h = _common(p, q, x)
        if h < len(p) and (h == len(q) or p[h] > q[h]):
            known[a] = h
            return b, a
        known[b] = h
        return a, b

    for node in range(leaves - 1, 0, -1):
        winners[node], loser[node] = lost(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while known[top] >= 0:
        yield top, known[top]
        known[top] = runs[top].step()
        node = (top + leaves) >> 1
        while node:
            other = loser[node]
            x, y = known[top], known[other]
            if y > x:
                loser[node], top = top, other
            elif y == x and x >= 0:
                top, loser[node] = lost(top, other)
            node >>= 1


def opened(keys: list[bytes], group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Masks of strings (bit 0: the first) of each key that another key of its group has with a smaller id."""
    flat = np.frombuffer(b"".join(keys), np.uint8)
    length = np.array([len(k) for k in keys])
    begin = np.cumsum(length) - length
    left = flat[begin + length - 1].astype(np.int64)
    right = length - 1 - left
    count = left + right - LENGTH + 1  # strings of the key
    own = np.repeat(np.arange(len(keys)), count)
    number = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    before = left[own] - number  # bytes of the string that lie before the anchor
    content = np.zeros((len(own), LENGTH + 6), np.uint8)
    column = np.arange(LENGTH)
    for lo in range(0, len(own), 16384):
        o, x = own[lo : lo + 16384], before[lo : lo + 16384, None]
        content[lo : lo + 16384, :LENGTH] = flat[begin[o][:, None] + np.where(column < x, right[o][:, None] + x - 1 - column, column - x)]
    h = mix64(group[own].astype(np.uint64) * _A + before.astype(np.uint64))
    for part in content.view("<u8").reshape(len(own), -1).T:
        h = mix64(h + part)
    order = np.lexsort((least[own], h))
    h = h[order]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    head = order[np.repeat(edge, np.diff(np.append(edge, len(h))))]
    later = least[own[order]] > least[own[head]]
    order, head = order[later], head[later]
    order = order[(content[order] == content[head]).all(1)]
    mask = np.zeros(len(keys), np.int64)
    np.bitwise_or.at(mask, own[order], np.int64(1) << number[order])
    return mask


def _merged(key: tuple, table_: pa.Table) -> pa.Table:
    """One part: merge the runs and tell each bucket of keys that an earlier
    document elsewhere has: their numbers in its run, the least id, and the
    strings that the suffix of the least id itself repeats.  The rows stand
    beside those of the cores, under the range -1 - part."""
    buckets = table_.column("bucket").to_pylist()
    runs = [Run(n, d) for n, d in zip(table_.column("n").to_pylist(), table_.column("data").to_pylist(), strict=True)]
    source, place, common, keys = [], [], [], []
    for r, c in merge(runs):
        run = runs[r]
        source.append(r)
        place.append(run.at)
        if keys and c == len(run.key) == len(keys[-1]):
            common.append(-1)  # the key before again
        else:
            common.append(c)
            keys.append(run.key)
    if not source:
        return _CORES.empty_table()
    source, place, common = np.array(source), np.array(place), np.array(common)
    smallest = np.empty(len(source), np.int64)
    for r, run in enumerate(runs):
        own = source == r
        smallest[own] = run.least[place[own]]
    number = np.cumsum(common >= 0) - 1  # of the distinct key
    least = np.minimum.reduceat(smallest, np.flatnonzero(common >= 0))
    core = np.cumsum(common[common >= 0] < CORE) - 1
    several = np.bincount(core)[core] > 1
    mask = np.zeros(len(keys), np.int64)
    open_ = np.flatnonzero(several)
    cut = 0
    while cut < len(open_):  # whole groups, some 20,000 keys at a time
        end = min(len(open_), cut + 20_000)
        end = int(np.searchsorted(core[open_], core[open_[end - 1]], "right"))
        part = open_[cut:end]
        mask[part] = opened([keys[i] for i in part], core[part], least[part])
        cut = end
    rows = []
    for r, run in enumerate(runs):
        own = source == r
        key_of = np.empty(run.n, np.int64)
        key_of[place[own]] = number[own]
        told = np.flatnonzero((least[key_of] < run.least) | (mask[key_of] > 0))
        if len(told):
            k = key_of[told]
            rows.append((buckets[r], -1 - key[0].as_py(), len(told), least[k].astype("<i8").tobytes() + mask[k].astype("<u4").tobytes() + pack_ascending(told)))
    return _table(rows, _CORES)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_bytes(bucket: Bucket, s: Suffixes, told: pa.Table) -> np.ndarray:
    least, mask = s.least.copy(), np.zeros(len(s.edge), np.int64)
    start = np.searchsorted(s.part, np.arange(int(s.part[-1]) + 2)) if len(s.part) else np.zeros(1, np.int64)
    for r, n, data in zip(told.column("range").to_pylist(), told.column("n").to_pylist(), told.column("data").to_pylist(), strict=True):
        if r < 0:
            at = start[-1 - r] + unpack_ascending(data[12 * n :])
            least[at], mask[at] = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u4", n, 8 * n)
    key = np.repeat(np.arange(len(s.edge)), np.diff(np.append(s.edge, len(s.first))))
    strings = (np.int64(1) << (s.length - LENGTH)) - 1  # all strings of a key
    own = np.where(s.ids > least[key], strings[key], mask[key])
    change = np.zeros(len(bucket.data) + LENGTH + 1, np.int32)
    for bit in range(PLACES):
        at = s.first[(own >> bit) & 1 == 1] + bit  # no anchor comes twice
        change[at] += 1
        change[at + LENGTH] -= 1
    return np.cumsum(change)[: len(bucket.data)] > 0


def _result(bits: int, splitters: np.ndarray) -> Callable:
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _RESULT.empty_table()
        bucket = Bucket(texts)
        gone = removed_bytes(bucket, Suffixes(bucket, told, bits, splitters), told) if told.num_rows else np.zeros(len(bucket.data), bool)
        return _digest(bucket, gone)

    return run


def _digest(bucket: Bucket, gone: np.ndarray) -> pa.Table:
    removed, spans, kept = [], [], []
    for a, b in zip(bucket.starts[:-1].tolist(), bucket.starts[1:].tolist(), strict=True):
        g = gone[a:b]
        n = int(g.sum())
        removed.append(n)
        spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(bool(n and g[0])))
        kept.append(hashlib.sha256((bucket.data[a:b][~g] if n else bucket.data[a:b]).tobytes()).hexdigest())
    return pa.Table.from_arrays([bucket.doc_ids.cast(pa.int64()), pa.array(np.diff(bucket.starts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], schema=_RESULT)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket = Bucket(pa.Table.from_batches([batch]))
        at = bucket.anchors()[0]
        at = at[mix64(at.astype(np.uint64)) % U64(16) == 0]
        yield pa.RecordBatch.from_arrays([pa.array([bucket.data[a : a + CORE].tobytes() for a in at.tolist()], pa.binary())], names=["core"])


def splitters(source: DataFrame, documents: int, parts: int) -> np.ndarray:
    """Cores that cut the order of suffixes in about equal parts, from about
    SAMPLE_DOCS documents, or more where there are more parts to cut."""
    share = max(1, documents // max(SAMPLE_DOCS, parts))
    rows = source.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(share)) == 0).select("doc_id", "text").mapInArrow(_sample, "core binary").distinct()
    cores = sorted(bytes(r["core"]) for r in rows.collect())  # bounded by the sample's texts
    cut = [cores[len(cores) * k // parts] for k in range(1, parts)] if cores else []
    return np.unique(np.array(cut, f"S{CORE}")) if cut else np.zeros(0, f"S{CORE}")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    size = total["b"] or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES), min(LEAST_BUCKETS, size // PASS))
    bits = min(20, max(4, (n_buckets // 8).bit_length()))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).cast("int").alias("bucket"))
    cut = splitters(source, total["n"], max(1, n_buckets // 2))
    by_bucket = source.groupBy("bucket")
    repeated = by_bucket.applyInArrow(_cores(bits), CORES).groupBy("range").applyInArrow(_repeated, CORES)
    runs = by_bucket.cogroup(repeated.groupBy("bucket")).applyInArrow(_runs(bits, cut), RUNS)
    told = repeated.unionByName(runs.groupBy("part").applyInArrow(_merged, CORES))
    return by_bucket.cogroup(told.groupBy("bucket")).applyInArrow(_result(bits, cut), RESULT)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(0, (length(h) + 199) // 200)) AS k, unnest(regexp_extract_all(h, '.{1,200}')) AS a FROM d),
w AS (SELECT doc_id, n, k, a || coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), '') AS a FROM k),
s AS (SELECT doc_id, 100 * k + i AS p, substr(a, 2 * i + 1, 100) AS s FROM (SELECT doc_id, n, k, a, unnest(range(0, least(100, greatest(n - 49 - 100 * k, 0)))) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
hit AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM s JOIN m USING (s) WHERE doc_id > first),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit) GROUP BY doc_id, k),
piece AS (SELECT doc_id, b AS f, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS t FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS r, count(*) AS k FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.k, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
