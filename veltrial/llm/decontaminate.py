"""Benchmark decontamination with a distributed positional inverted index.

The training side is indexed by segment (a block of documents): for each term of
the benchmark's vocabulary, the ascending list of word positions in the
segment.  A term outside that vocabulary can take part in no match and is not
stored.  Phrases are found by intersection: the list of the phrase's rarest term
in the segment, minus that term's offset, is cut down by the offset-adjusted
list of the next rarest term, until it is empty or all terms have agreed.

Only the benchmark (the test set) is sent to every task, in blocks of at most
BLOCK_ITEMS items and BLOCK_BYTES of text; more blocks mean more passes over the
index, never a dropped item.  For several blocks the documents are written once
with a number each, by which the blocks' findings are brought together.  In a
segment only the windows take part whose terms all occur in it.

Defined cases: null or empty text has no words; an item without words never
occurs; an item with fewer words than a window is one window; repeated document
rows stay rows of their own; documents with equal ids are not merged; items with
equal ids are one item, and so are all items without an id: they are counted,
but have no id in the digest; ids may hold any characters; empty tables give
empty results or zero counts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import TextBlock, pack_gaps, released, rows_of, shared_checkpoint, table, task_key, text_blocks, unpack_gaps, unused, words

WINDOW = 13
#: A document is contaminated when at least one in this many of its words is hit.
HIT_SHARE = 20
SEGMENT_BYTES = 4 << 20
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 4 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: Bytes of a word: digits, letters and all of any code point from U+0080.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True


class Phrases:
    """Windows of a block of benchmark items, over a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.item_ids = [None if i is None else str(i) for i, _ in items]
        hashes = []
        for _, text in items:
            block = next(text_blocks(pa.array([text], pa.string()), separator=b"\n"))
            hashes.append(words(block, IS_WORD, FOLD)[2])
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        known: dict[tuple, int] = {}
        self.windows: list[tuple[int, ...]] = []
        self.owners: list[set[int]] = []
        for k, h in enumerate(hashes):
            t = tuple(np.searchsorted(self.vocabulary, h).tolist())
            for i in range(max(1, len(t) - window + 1) if t else 0):
                w = t[i : i + window]
                n = known.setdefault(w, len(self.windows))
                if n == len(self.windows):
                    self.windows.append(w)
                    self.owners.append(set())
                self.owners[n].add(k)
        longest = max(map(len, self.windows), default=1)
        self.table = np.full((len(self.windows), longest), -1, np.int32)
        for n, w in enumerate(self.windows):
            self.table[n, : len(w)] = w
        self.lengths = np.array([len(w) for w in self.windows], np.int64)

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """Windows whose terms are all among these."""
        has = np.zeros(len(self.vocabulary) + 1, bool)
        has[terms] = True
        has[-1] = True  # past a window's end
        left = np.arange(len(self.table))
        for k in range(self.table.shape[1]):
            left = left[has[self.table[left, k]]]
        return left


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Phrases]:
    """Blocks of items whose size is checked as they are read, one at a time."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").encode())
        if len(part) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Phrases(part, window)
            part, size = [], 0
    if part:
        yield Phrases(part, window)


INDEX_SCHEMA = "segment long, term int, n long, postings binary, doc_ids binary"


def _index(vocabulary: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = task_key()
        for batch in batches:
            for block in text_blocks(batch.column("text"), SEGMENT_BYTES, b"\n"):
                ids, keys = (batch.column(c).slice(block.lo, block.hi - block.lo) for c in ("doc_id", "key"))
                yield _segment(segment, ids, keys, block, vocabulary)
                segment += 1

    return run


def _segment(segment: int, ids: pa.Array, keys: pa.Array, block: TextBlock, vocabulary: np.ndarray) -> pa.RecordBatch:
    begin, _, hashes = words(block, IS_WORD, FOLD)
    count = np.bincount(rows_of(begin, block.starts), minlength=len(ids)).astype(np.int64)
    rows = [(-1, len(ids), count.tobytes(), ids.cast(pa.int64()))]
    if len(vocabulary) and len(hashes):
        term = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        at = np.flatnonzero(vocabulary[term] == hashes)
        order = np.argsort(term[at], kind="stable")
        at, term = at[order], term[at][order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gap = np.diff(at, prepend=0)
        gap[first] = at[first]
        packed, begins = pack_gaps(gap)
        cut = np.append(begins[first], len(packed))
        for k, (a, b) in enumerate(zip(first, [*first, len(at)][1:], strict=True)):
            rows.append((int(term[a]), b - a, packed[cut[k] : cut[k + 1]].tobytes(), None))
    doc_ids = rows[0][3]
    known = np.frombuffer(doc_ids.is_valid().cast(pa.uint8()).buffers()[1], np.uint8)[: len(ids)]
    packed = np.concatenate([known.astype(np.int64), doc_ids.fill_null(0).to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)]).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), segment), pa.int64()),
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.binary()),
            pa.array([packed] + [None] * (len(rows) - 1), pa.binary()),
        ],
        names=["segment", "term", "n", "postings", "doc_ids"],
    )


def positional_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(segment, term, n, postings, doc_ids): term -1 is the segment's row of
    word counts, document ids and keys; positions count the words of the segment."""
    key = F.col("key") if "key" in docs.columns else F.lit(0).cast("long").alias("key")
    return docs.select(F.col("doc_id").cast("long"), "text", key).mapInArrow(released(_index(vocabulary)), INDEX_SCHEMA)


#: A posting is term << 32 | position: one sorted array holds all lists of a segment.
TERM_SHIFT = 32


def posting_lists(terms: pd.DataFrame) -> np.ndarray:
    """All postings of a segment, ordered by term, then position."""
    terms = terms.sort_values("term")
    count = terms["n"].to_numpy(np.int64)
    if not len(count):
        return np.zeros(0, np.int64)
    total = np.cumsum(unpack_gaps(np.frombuffer(b"".join(terms["postings"]), np.uint8)))
    first = np.cumsum(count) - count
    before = np.concatenate(([0], total[first[1:] - 1]))
    return (np.repeat(terms["term"].to_numpy(np.int64), count) << TERM_SHIFT) | (total - np.repeat(before, count))


def intersect(lists: np.ndarray, table: np.ndarray, slop: int = 0, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, position at which it begins, position of its rarest term) of every match.

    table: a phrase's terms by row, -1 past its end.  Every phrase starts from
    the list of its rarest term, less that term's offset; each next rarest term
    keeps the starts that its own offset-adjusted list holds too.  With slop, a
    term may lie up to that many words off its place (proximity matches), but not
    outside the document, one of those that end at ``ends``, of the rarest term."""
    table = table.astype(np.int64)
    terms = np.where(table < 0, 0, table)
    begin = np.searchsorted(lists, terms << TERM_SHIFT)
    count = np.where(table < 0, np.iinfo(np.int64).max, np.searchsorted(lists, (terms + 1) << TERM_SHIFT) - begin)
    rank = np.argsort(count, axis=1, kind="stable")
    pick = np.arange(len(table)), rank[:, 0]
    size = np.where(table.max(1, initial=-1) < 0, 0, count[pick])
    phrase = np.repeat(np.arange(len(table)), size)
    first = np.repeat(begin[pick] - (np.cumsum(size) - size), size) + np.arange(len(phrase))
    rarest = lists[first] & ((1 << TERM_SHIFT) - 1) if len(first) else np.zeros(0, np.int64)
    start = rarest - rank[phrase, 0]
    if not slop:  # with slop, the rarest term may stand left of its place
        phrase, start, rarest = phrase[start >= 0], start[start >= 0], rarest[start >= 0]
    for k in range(1, table.shape[1]):
        if not len(start):
            break
        offset = rank[phrase, k]
        term = table[phrase, offset]
        want = (term << TERM_SHIFT) + start + offset
        low, high = np.maximum(want - slop, term << TERM_SHIFT), want + slop
        if slop and ends is not None:
            d = np.searchsorted(ends, rarest, "right")
            low = np.maximum(low, (term << TERM_SHIFT) + np.where(d > 0, ends[d - 1], 0))
            high = np.minimum(high, (term << TERM_SHIFT) + ends[d] - 1)
        at = np.searchsorted(lists, low)
        hit = (at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] <= high)
        hit &= lists[np.minimum(at, len(lists) - 1)] >> TERM_SHIFT == term
        hit |= term < 0
        phrase, start, rarest = phrase[hit], start[hit], rarest[hit]
    return phrase, start, rarest


def segment_matches(pdf: pd.DataFrame, phrases: Phrases, slop: int = 0) -> tuple[pd.DataFrame, list[tuple[int, int, int, int]]]:
    """Per document: key, id and words; and (document's place, first word, length, window) of each match."""
    head = pdf[pdf["term"] == -1].iloc[0]
    n_docs = int(head["n"])
    count = np.frombuffer(head["postings"], np.int64)
    packed = np.frombuffer(head["doc_ids"], np.int64)
    known, ids, keys = packed[:n_docs].astype(bool), packed[n_docs : 2 * n_docs], packed[2 * n_docs :]
    docs = pd.DataFrame({"key": keys, "doc_id": pd.array(np.where(known, ids, 0), "Int64").copy(), "n_words": count})
    docs.loc[~known, "doc_id"] = pd.NA
    ends = np.cumsum(count)
    begins = ends - count
    lists = posting_lists(pdf[pdf["term"] >= 0])
    if not len(lists) or not len(phrases.windows):
        return docs, []
    possible = phrases.possible(pdf["term"].to_numpy()[pdf["term"].to_numpy() >= 0])
    if not len(possible):
        return docs, []
    window, at, rarest = intersect(lists, phrases.table[possible], slop, ends)
    window = possible[window]
    length = phrases.lengths[window]
    if slop:  # the postings were held to their document; the nominal place may reach over its edges
        d = np.searchsorted(ends, rarest, "right")
        at = np.maximum(at, begins[d])
        good = np.ones(len(at), bool)
    else:
        d = np.minimum(np.searchsorted(ends, at, "right"), n_docs - 1)
        good = (at >= begins[d]) & (at + length <= ends[d])
    return docs, list(zip(d[good].tolist(), (at - begins[d])[good].tolist(), length[good].tolist(), window[good].tolist(), strict=True))


HIT_SCHEMA = "key long, doc_id long, n_words long, hits binary, items array<string>"


def _hits(phrases: Phrases) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, found = segment_matches(pdf, phrases)
        hits: dict[int, np.ndarray] = {}
        items: dict[int, set[str | None]] = {}
        for d, p, n, w in found:
            if d not in hits:
                hits[d] = np.zeros(int(docs["n_words"].iloc[d]), bool)
                items[d] = set()
            hits[d][p : p + n] = True
            items[d].update(phrases.item_ids[k] for k in phrases.owners[w])
        docs["hits"] = [np.flatnonzero(hits[d]).astype(np.int64).tobytes() if d in hits else b"" for d in range(len(docs))]
        docs["items"] = [list(items.get(d, ())) for d in range(len(docs))]
        return docs[["key", "doc_id", "n_words", "hits", "items"]]

    return run


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """doc_id, n_words, and lists of hits and items -> RESULT."""
    n_hit, n_items, digest = [], [], []
    for hits, items in zip(pdf["hits"], pdf["items"], strict=True):
        blobs = [h for h in hits if h]
        n_hit.append(len(np.unique(np.frombuffer(b"".join(blobs), np.int64))) if blobs else 0)
        ids = {x for part in items for x in part}
        n_items.append(len(ids))
        digest.append(hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest())
    hit = np.array(n_hit, np.int64)
    words_ = pdf["n_words"].to_numpy(np.int64)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words_, "n_hit": hit, "n_items": n_items, "items_sha256": digest, "contaminated": (hit > 0) & (HIT_SHARE * hit >= words_)})


def _judged(phrases: Phrases) -> Callable:
    """Hits and their summary in one step, where the benchmark is one block."""
    hits = _hits(phrases)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = hits(pdf)
        return _summary(docs.assign(hits=[[h] for h in docs["hits"]], items=[[x] for x in docs["items"]]))

    return run


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _summary(pdf)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    blocks = benchmark_blocks(benchmark, window)
    own, more = next(blocks, None) or Phrases([], window), next(blocks, None)
    if more is None:
        return positional_index(docs, own.vocabulary).groupBy("segment").applyInPandas(_judged(own), RESULT)
    # each block scans the documents: numbers that a scan made up could differ from the next one's
    docs = shared_checkpoint(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key")))
    every = None
    while own is not None:  # a block's hits are written before the driver reads the block after the next
        found = shared_checkpoint(positional_index(docs, own.vocabulary).groupBy("segment").applyInPandas(_hits(own), HIT_SCHEMA).where("octet_length(hits) > 0" if every is not None else "true"))
        every = found if every is None else every.unionByName(found)
        own, more = more, next(blocks, None)
    rows = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")).drop("key")
    return rows.mapInPandas(_summaries, RESULT)


MATCH_SCHEMA = "doc_id long, item_id string, start long, words long"


def _matches(phrases: Phrases, slop: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, found = segment_matches(pdf, phrases, slop)
        rows = [(docs["doc_id"].iloc[d], phrases.item_ids[k], p, n) for d, p, n, w in found for k in sorted(phrases.owners[w])]  # an item without an id: null
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "words"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every match: doc_id, item_id, start (word number) and words; slop > 0 gives proximity matches."""
    out = None
    for phrases in benchmark_blocks(benchmark, window):
        one = positional_index(docs, phrases.vocabulary).groupBy("segment").applyInPandas(_matches(phrases, slop), MATCH_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], MATCH_SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows, all columns, that aren't contaminated.  Each row is judged by its own
    text, with a null id or one that others have too; equal rows go together.
    Null and empty texts stay; empty table: empty result."""
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    bad = contamination(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, window).where("contaminated").select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(bad, row, "left_anti").select(docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT pos.doc_id, pos.p, pos.n, win.item_id FROM pos JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
