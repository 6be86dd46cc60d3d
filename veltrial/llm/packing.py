"""Packing documents into training sequences by first-fit decreasing.

Each document becomes its token ids plus one end id.  Whole multiples of the
sequence length are cut off the front and fill sequences of their own; what is
left (at most one piece a document) is dealt to groups by a seeded hash.  In a
group the pieces go, longest first, into the first sequence with room, found by
a tournament tree over the bins' remaining capacities.  Groups are independent,
so the work is parallel and a group's size depends on GROUP_PIECES alone.

Tokenising works on distinct words: the text is split as the tokenizer's own
pre-tokenizer does, over code-point classes read from the tokenizer library, and
only words that the worker has not met run through the BPE model.  Words are
found by a 64-bit hash of all their bits, and each is held against the length and
the outer letters of the word that its ids were made of.  Where these differ, and
where a text holds a special token's string, the tokenizer gets the texts whole.

Defined cases: null or empty text is the end id alone; repeated rows and ids are
rows of their own; no document is dropped or cut short; empty table: empty
result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import PASS_BYTES, hash_ranges, mix64, released, table, task_key, text_blocks

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 8192
#: Words whose ids one worker keeps, and new ones among them that aren't yet in the sorted table.
CACHE_WORDS, NEW_WORDS = 400_000, 16_384


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The map from bytes to the printable characters of byte-level BPE vocabularies.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def code_point_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own regex engine sees it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    classes = np.zeros(0x110000, np.uint8)
    for start in range(0, 0x110000, 0x4000):  # in pieces: the library returns a string for each run
        points = np.arange(start, start + 0x4000, dtype=np.uint32)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        text = points.tobytes().decode("utf-32-le")
        for pattern, kind in ((r"[\p{L}]+", LETTER), (r"[\p{N}]+", NUMBER), (r"\s+", SPACE)):
            for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                classes[points[a:b]] = kind
    return classes


class WordTokenizer:
    """Ids of whole texts, equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.classes = code_point_classes()
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.entries, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        self.marks = np.zeros(1024, np.int64)
        self.starts, self.lengths, self.ids, self.used, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0

    def _add(self, key: int, word: str) -> int:
        ids = [t.id for t in self.model.tokenize("".join(_BYTE_CHARS[b] for b in word.encode()))]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        if self.count == len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(self.count, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(self.count, np.int64)])
            self.marks = np.concatenate([self.marks, np.zeros(self.count, np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.count], self.lengths[self.count] = self.used, len(ids)
        self.used += len(ids)
        self.marks[self.count] = (len(word) << 42) | (ord(word[0]) << 21) | ord(word[-1])
        self.new[key] = self.count
        self.count += 1
        return self.count - 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.entries[at], -1)

    def _settle(self) -> None:
        """Merge the new words into the sorted table."""
        hashes = np.fromiter(self.new.keys(), np.uint64, len(self.new))
        order = np.argsort(hashes)
        hashes = np.concatenate([self.hashes, hashes[order]])
        entries = np.concatenate([self.entries, np.fromiter(self.new.values(), np.int64, len(self.new))[order]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.entries, self.new = hashes[order], entries[order], {}

    def normal(self, text: str) -> str:
        # the library lowers each character by itself; str.lower alone treats a final sigma apart
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and each text's number of ids."""
        whole = {i: self.whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        joined = "\n".join("" if i in whole else self.normal(t) for i, t in enumerate(texts)) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[points]
        begin, end = self._split(points, kind)
        text_ends = np.flatnonzero(points == 10)
        if len(text_ends) != len(texts):  # texts with line ends of their own: count by lengths
            size = np.array([0 if i in whole else len(self.normal(t)) for i, t in enumerate(texts)])
            text_ends = np.cumsum(size + 1) - 1
        hashes = self._hash(points, begin, end)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.count + len(unique) > CACHE_WORDS and self.count:
            self._reset()
        entry = self._find(unique)
        for j in np.flatnonzero(entry < 0).tolist():
            h = int(unique[j])
            k = self.new.get(h, -1)
            entry[j] = self._add(h, joined[begin[where[j]] : end[where[j]]]) if k < 0 else k
        if len(self.new) > NEW_WORDS:
            self._settle()
        entry = entry[inverse]
        mark = ((end - begin) << 42) | (points[begin].astype(np.int64) << 21) | points[end - 1]
        if (self.marks[entry] != mark).any():  # two words of one hash
            every = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
            return np.concatenate([*every, np.zeros(0, np.int32)]), np.array([len(x) for x in every], np.int64)
        length = self.lengths[entry]
        first = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.ids[np.arange(total) - np.repeat(first - self.starts[entry], length)]
        per_text = np.bincount(np.searchsorted(text_ends, begin), weights=length, minlength=len(texts)).astype(np.int64)
        if whole:
            cut = np.split(ids, np.cumsum(per_text)[:-1])
            for i, x in whole.items():
                cut[i] = np.array(x, np.int32)
                per_text[i] = len(x)
            ids = np.concatenate(cut)
        return ids, per_text

    def _split(self, points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(points), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quote = np.flatnonzero(points == 0x27)
        if len(quote):  # 's 't 'm 'd 're 've 'll stand alone where the quote opens a word
            quote = quote[new[quote]]
            at = lambda k: points[np.minimum(quote + k, len(points) - 1)]
            one = np.isin(at(1), [ord(c) for c in "stmd"])
            two = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (at(1) == ord(a)) & (at(2) == ord(b))
            size = np.where(one, 2, np.where(two, 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            new[quote + 1] = False
            three = quote[size == 3] + 2
            new[three] = False
            after = quote + size
            new[after[after < len(points)]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(points))
        keep = kind[begin] != SPACE
        return begin[keep], end[keep]

    @staticmethod
    def _hash(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = hash_ranges((points & 0xFF).astype(np.uint8), begin, end)
        for plane in (8, 16):  # all bits count: words that need higher bytes mix them in
            high = (points >> plane).astype(np.uint8) if len(points) and points.max() >> plane else np.zeros(0, np.uint8)
            at = np.flatnonzero(high)
            word = np.searchsorted(begin, at, "right") - 1
            word = word[word >= 0] if len(begin) else word[:0]
            at = at[len(at) - len(word) :]
            word = np.unique(word[at < end[word]])
            if len(word):
                key[word] ^= mix64(hash_ranges(high, begin[word], end[word]) + np.uint64(plane))
        return key


PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, document long"
_READY: dict[str, WordTokenizer] = {}


def _pieces(path: str, length: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _READY:
            _READY[path] = WordTokenizer(path)
        tokenizer, document = _READY[path], task_key()
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            for block in text_blocks(texts, PASS_BYTES):
                ids, count = tokenizer.encode(texts.slice(block.lo, block.hi - block.lo).to_pylist())
                rows, at = [], 0
                for i, n in enumerate(count.tolist()):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for s in range(0, n + 1, length):
                        part = own[s : s + length]
                        rows.append((block.lo + i, n + 1, s, len(part), zlib.crc32(part.tobytes())))
                cols = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:]), pa.array(document + cols[0])],
                    names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "document"],
                )
            document += batch.num_rows

    return run


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, doc_tokens, start, length, ids_crc32, document (tells rows apart)."""
    return docs.select("doc_id", "text").mapInArrow(released(_pieces(path or tokenizer_path(), length, end_id)), PIECES)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece.  A tournament tree holds the largest remaining
    capacity under each node; the first bin with room is found from the root."""
    order = np.argsort(-sizes, kind="stable").tolist()
    sizes = sizes.tolist()
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.empty(len(sizes), np.int64)
    for piece in order:
        size, node = sizes[piece], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[piece] = node - leaves
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def _pack(length: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "document"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = (pdf["pack_group"].to_numpy() << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # a token is a byte at least, so a text has at most this many pieces; long texts add groups, not to a group
    most = F.ceil((F.octet_length(F.coalesce("text", F.lit(""))) + 1) / length)
    groups = max(1, -(-(docs.agg(F.sum(most)).first()[0] or 0) // GROUP_PIECES))
    pieces = token_pieces(docs, path, length, end_id)
    # a piece that fills a sequence needs no packing partner, but shares the group's numbering
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("document", "start"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(_pack(length), PACKED)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
