"""N-gram Jaccard join with a token-group matrix.

Sets are the distinct word shingles of a text, as 64-bit hashes; two link when
100 * intersection >= percent * union.

1. Postings.  Blocks of documents send each distinct shingle, packed, to one of
   2^b token ranges; a set that occurs again in its block is sent once, and so is
   a shingle that HOT sets of the block have, with their number.
2. Token ranges find each shingle's document frequency.  A shingle of one
   document can be in no intersection, so only the others go back, packed, to
   their block, with their frequency.
3. In the order "rare first", two sets that link must share one of the first
   n - ceil(percent n / 100) + 1 shingles of each.  Most documents fill these places with
   shingles of their own and are done here; the rest are candidates.
4. Equal sets become one class.  Candidate classes are partitioned into groups
   of similar sets: each class joins the class that most of its leading shingles
   elect, in groups of at most about GROUP_CLASSES.  The token-group matrix
   holds, for each group, its leading shingles; a pair of groups that share one
   is looked at once.
5. A pair of groups first bounds, for each set of one, its overlap with the
   other group's token union; only sets that reach their percentage of their
   own size open the other group.  Within an opened pair, sets already known to be connected
   are not compared again.
   Where a hub has several groups, each is first compared with the hub's first
   one alone.  After that nearly all of a group of copies is connected: the few
   classes that aren't go to groups of their own, and groups that lie in one
   component are not compared with each other.
6. Links join classes; components come from distributed star contraction.

Defined cases: null, empty or word-less text has an empty set and links with
nothing; a text of fewer words than a shingle is one shingle; repeated rows and
equal ids stay rows of their own and share a class; a set that only rows without
a doc_id have links with nothing but itself (there is no id to name it by), and
their component is null; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veltrial.llm.common import U64, mix64, pack_ascending, release, released, rows_of, shared_checkpoint, table, task_key, text_blocks, unpack_ascending, unused, words
from veltrial.llm.components import connected_components

#: Words of a shingle and percentage of the union, unless the caller says otherwise.
WORDS, PERCENT = 5, 80
#: Postings of a block, documents of a block (their numbers take 16 bits), and postings a token range should hold.
BLOCK_TOKENS, BLOCK_DOCS, RANGE_TOKENS = 1 << 20, 1 << 15, 1 << 21
#: Sets of a block from which on a shingle's list of sets stays with the block.
HOT, SEE_HEAD = 16, 0xFFFF
GROUP_CLASSES = 256
#: Groups of a hub that are all compared with each other, without a look at what is connected first.
FEW_GROUPS = 4

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block, ordered by row, then hash."""
    begin, _, h = words(block, IS_WORD, FOLD)
    row = rows_of(begin, block.starts)
    n = np.bincount(row, minlength=len(block.starts) - 1)
    token, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= width:
        token = sum((h[i : len(h) - width + 1 + i] * _FACTORS[i % 8] + U64(i) for i in range(1, width)), h[: len(h) - width + 1] * _FACTORS[0])
        whole = row[: len(h) - width + 1] == row[width - 1 :]
        token, owner = mix64(token[whole]), row[: len(h) - width + 1][whole]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):  # fewer words: the sequence is one shingle
        first = (np.cumsum(n) - n)[short]
        value = U64(0x5DEECE66D) * (n[short].astype(np.uint64) + U64(1))
        for i in range(width - 1):
            has = n[short] > i
            value = np.where(has, mix64(value + h[np.minimum(first + i, len(h) - 1)] * _FACTORS[i % 8]), value)
        token, owner = np.concatenate([token, value]), np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], token[fresh]


def set_digests(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free 64-bit digests of the sets."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        one[some] = np.add.reduceat(mix64(token), first)
        two[some] = np.add.reduceat(mix64(token ^ _FACTORS[3]), first)
    return n, one.view(np.int64), two.view(np.int64)


POSTINGS = "block long, range int, n long, tokens binary, rows binary, doc_id binary"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["block", "range", "n", "tokens", "rows", "doc_id"]


def _pack(block: int, bits: int, row: np.ndarray, token: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """A row for each token range: the shingles, 40 bits of each, as packed
    differences; the set of each, or SEE_HEAD; and the number of sets of those.
    Beside them, the sets of the hot shingles, back to back, and their numbers."""
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order].astype("<u2")
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(token)))
    hot = np.repeat(times >= HOT, times)
    stays, sizes = row[hot], times[times >= HOT]
    sent = ~hot
    sent[first] = True
    row = np.where(hot, SEE_HEAD, row)[sent].astype("<u2")
    token = token[sent]
    ranges = (token >> U64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(ranges, prepend=-1))
    out, at = [], 0
    for a, b in zip(edge, [*edge, len(token)][1:], strict=True):
        t = (token[a:b] >> U64(64 - bits - 40)) & U64((1 << 40) - 1)
        n_hot = int((row[a:b] == SEE_HEAD).sum())
        out.append((block, int(ranges[a]), int(b - a), pack_ascending(t), row[a:b].tobytes() + sizes[at : at + n_hot].astype("<u4").tobytes(), None))
        at += n_hot
    return out, stays, sizes


def _postings(bits: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held, count, ids = task_key(), [], 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, rows, held, count, ids
            row = np.concatenate([r for r, _, _, _, _ in rows])
            token = np.concatenate([t for _, t, _, _, _ in rows])
            n, one, two = (np.concatenate([r[k] for r in rows]) for k in (2, 3, 4))
            ids_ = pa.concat_arrays(ids).cast(pa.int64())
            known = ids_.is_valid().to_numpy(zero_copy_only=False)
            _, first = np.unique(np.stack([n, one, two]), axis=1, return_index=True)
            sent = np.zeros(count, bool)
            sent[first] = True
            keep = sent[row]
            packed, stays, sizes = _pack(block, bits, row[keep], token[keep])
            head = np.concatenate([n, one, two, known.astype(np.int64), ids_.fill_null(0).to_numpy(zero_copy_only=False), sizes])
            # the block's head goes through one of the token ranges, so that the texts are read once
            out = [(block, block % (1 << bits), count, None, stays.tobytes(), head.tobytes()), *packed]
            block, rows, held, count, ids = block + 1, [], 0, 0, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for b in text_blocks(batch.column("text"), separator=b"\n"):
                for lo in range(0, b.hi - b.lo, BLOCK_DOCS):  # a block of very short texts may hold too many
                    hi = min(b.hi - b.lo, lo + BLOCK_DOCS)
                    if count and (count + hi - lo > BLOCK_DOCS or held >= BLOCK_TOKENS):
                        yield flush()
                    part = type(b)(b.lo + lo, b.lo + hi, b.data[b.starts[lo] : b.starts[hi]], b.starts[lo : hi + 1] - b.starts[lo])
                    row, token = shingle_sets(part, width)
                    rows.append((row + count, token, *set_digests(row, token, hi - lo)))
                    ids.append(batch.column("doc_id").slice(part.lo, hi - lo))
                    count, held = count + hi - lo, held + len(token)
        if count:
            yield flush()

    return run


def _frequencies() -> Callable:
    """One token range: postings of the shingles that several sets have, for
    each block.  They are numbered anew in their range: four bytes name one
    exactly.  Their frequency is kept as an eighth of a power of two: the order
    of shingles must be the same for all sets, not exact."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf[pdf["doc_id"].notna()]
        pdf = pdf[pdf["doc_id"].isna()].reset_index(drop=True)
        if not len(pdf):
            return heads
        token, row, block, times = [], [], [], []
        for k, (n, tokens, rows) in enumerate(zip(pdf["n"], pdf["tokens"], pdf["rows"], strict=True)):
            token.append(unpack_ascending(tokens))
            own = np.frombuffer(rows, "<u2", n)
            count = np.ones(n, np.uint32)
            count[own == SEE_HEAD] = np.frombuffer(rows, "<u4", -1, 2 * n)
            row.append(own)
            times.append(count)
            block.append(np.full(n, k, np.int32))
        token, row, block, times = (np.concatenate(x) for x in (token, row, block, times))
        order = np.argsort(token, kind="stable")
        token = token[order]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        df = np.add.reduceat(times[order].astype(np.int64), edge)
        size = np.diff(np.append(edge, len(token)))
        number = np.repeat(np.cumsum(df > 1) - 1, size)
        df = np.repeat(df, size)
        shared = df > 1
        number, df, order = number[shared].astype("<u4"), np.minimum(np.round(8 * np.log2(df[shared])), 255).astype(np.uint8), order[shared]
        row, block = row[order], block[order]
        by_block = np.argsort(block, kind="stable")
        number, df, row, block = (x[by_block] for x in (number, df, row, block))
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        out = []
        for a, b in zip(edge, [*edge, len(block)][1:], strict=True):
            out.append((int(pdf["block"].iloc[block[a]]), int(pdf["range"].iloc[0]), int(b - a), number[a:b].tobytes() + df[a:b].tobytes(), row[a:b].astype("<u2").tobytes(), None))
        del token, df, row, block, times, order
        release()
        return pd.concat([heads, pd.DataFrame(out, columns=_NAMES)])

    return run


SETS = "doc_id long, n long, one long, two long, shared binary, leading binary"


def _sets(percent: int) -> Callable:
    """One block: a row per document; candidates carry their shared and their leading shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["doc_id"].notna()].iloc[0]
        count = int(head["n"])
        packed = np.frombuffer(head["doc_id"], np.int64)
        n, one, two, known, ids = packed[: 5 * count].reshape(5, count)
        sizes, stays = packed[5 * count :], np.frombuffer(head["rows"], "<u2")
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy(), "n": n, "one": one, "two": two})
        out.loc[known == 0, "doc_id"] = pd.NA
        shared: list[bytes | None] = [None] * count
        leading: list[bytes | None] = [None] * count
        rest = pdf[pdf["doc_id"].isna()].sort_values("range")
        if len(rest):
            token, df, row = [], [], []
            for r, m, tokens, rows in zip(rest["range"], rest["n"], rest["tokens"], rest["rows"], strict=True):
                token.append(np.frombuffer(tokens, "<u4", m) | (U64(r) << U64(32)))
                df.append(np.frombuffer(tokens, np.uint8, m, 4 * m))
                row.append(np.frombuffer(rows, "<u2", m))
            token, df, row = np.concatenate(token), np.concatenate(df), np.concatenate(row)
            # every hot shingle comes back, in the order of its hash, which is the order of the head's lists
            times = np.ones(len(row), np.int64)
            times[row == SEE_HEAD] = sizes
            hot = np.repeat(row == SEE_HEAD, times)
            token, df, row = (np.repeat(x, times) for x in (token, df, row))
            row[hot] = stays
            row = row.astype(np.int64)
            order = np.lexsort((token, df, row))
            token, row = token[order], row[order]
            have = np.bincount(row, minlength=count)
            start = np.cumsum(have) - have
            places = n - -(-percent * n // 100) + 1 - (n - have)  # leading places left to shared shingles
            # the best partner of another set is a superset of one more shingle
            for d in np.flatnonzero((places > 0) & (have > 0) & (100 * n >= percent * (n + 1))):
                own = token[start[d] : start[d] + have[d]]
                leading[d] = own[: places[d]].tobytes()
                shared[d] = np.sort(own).tobytes()
        out["shared"], out["leading"] = shared, leading
        release()
        return out

    return run


def document_sets(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """SETS of all documents: steps 1 to 3."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(6, (size // 6 // RANGE_TOKENS).bit_length()))
    postings = docs.select("doc_id", "text").mapInArrow(released(_postings(bits, width)), POSTINGS)
    return postings.groupBy("range").applyInPandas(_frequencies(), POSTINGS).groupBy("block").applyInPandas(_sets(percent), SETS)


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(b, np.int64) for b in batch.column("leading").to_pylist()]
        size = np.array([len(x) for x in lists], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("class_id").to_numpy(), size)), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))], names=["class_id", "token"])


class Links:
    """Union-find over the classes of one task."""

    def __init__(self, ids: np.ndarray):
        self.parent = {int(i): int(i) for i in ids}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _incidence(lists: list[np.ndarray], union: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the tokens of the lists that lie in the sorted union."""
    flat = np.concatenate([*lists, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.minimum(np.searchsorted(union, flat), max(len(union) - 1, 0))
    hit = union[at] == flat if len(union) else np.zeros(len(flat), bool)
    return row[hit], at[hit]


def link_groups(a: pd.DataFrame, b: pd.DataFrame, links: Links, same: bool, percent: int) -> list[tuple[int, int]]:
    """New links between sets of two groups (or of one), as pairs of class ids."""
    out: list[tuple[int, int]] = []
    lists_a, lists_b = ([np.frombuffer(x, np.uint64) for x in g["shared"]] for g in (a, b))
    n_a, n_b = a["n"].to_numpy(), b["n"].to_numpy()
    ids_a, ids_b = a["class_id"].to_numpy(), b["class_id"].to_numpy()
    union_b = np.unique(np.concatenate(lists_b))
    row, column = _incidence(lists_a, union_b)
    bound = np.bincount(row, minlength=len(lists_a))
    opens = np.flatnonzero(100 * bound >= percent * n_a)  # the rest can't reach a set of this group
    if not len(opens):
        return out
    used = np.unique(column[np.isin(row, opens)])
    place = np.full(len(union_b), -1)
    place[used] = np.arange(len(used))
    row_b, column_b = _incidence(lists_b, union_b)
    fine = place[column_b] >= 0
    matrix = np.zeros((len(lists_b), len(used)), np.float32)
    matrix[row_b[fine], place[column_b[fine]]] = 1
    start = np.searchsorted(row, np.arange(len(lists_a) + 1))
    for lo in range(0, len(opens), 32):
        part = opens[lo : lo + 32]
        root_b = np.array([links.find(int(i)) for i in ids_b])
        part = [x for x in part if (root_b != links.find(int(ids_a[x]))).any()]
        if not part:
            continue
        query = np.zeros((len(part), len(used)), np.float32)
        for k, x in enumerate(part):
            query[k, place[column[start[x] : start[x + 1]]]] = 1
        both = (query @ matrix.T).astype(np.int64)
        linked = 100 * both >= percent * (n_a[part][:, None] + n_b[None, :] - both)
        for k, y in zip(*np.nonzero(linked), strict=True):
            x = part[k]
            if not (same and ids_a[x] == ids_b[y]) and links.join(int(ids_a[x]), int(ids_b[y])):
                out.append((int(ids_a[x]), int(ids_b[y])))
    return out


def _within(percent: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id", ignore_index=True)
        links = Links(pdf["class_id"])
        link_groups(pdf, pdf, links, True, percent)
        pdf["local"] = [links.find(int(i)) for i in pdf["class_id"]]
        release()
        return pdf[["hub", "chunk", "class_id", "n", "shared", "local"]]

    return run


def _between(percent: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id", ignore_index=True)
        links = Links(np.concatenate([pdf["class_id"].to_numpy(), pdf["local"].to_numpy()]))
        for i, root in zip(pdf["class_id"], pdf["local"], strict=True):
            links.join(int(i), int(root))
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = link_groups(a, b, links, False, percent) if len(a) and len(b) else []
        release()
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def class_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """classes(class_id, n, shared, leading) -> edges (u, v) that connect what links: steps 4 and 5."""
    leading = classes.mapInArrow(_longs, "class_id long, token long")
    # a leading shingle that one class alone has can elect nobody
    elected = leading.groupBy("token").agg(F.count("*").alias("size"), F.min_by("class_id", F.xxhash64("class_id")).alias("hub")).where("size > 1").drop("size")
    votes = shared_checkpoint(leading.join(elected, "token"))
    choice = votes.groupBy("class_id", "hub").agg(F.count("*").alias("votes")).groupBy("class_id").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    sizes = choice.groupBy("hub").agg(F.count("*").alias("size"))
    member = choice.join(sizes, "hub").select("class_id", "hub", F.pmod(F.xxhash64("class_id", F.lit(1)), F.ceil(F.col("size") / GROUP_CLASSES)).cast("int").alias("chunk"))
    groups = shared_checkpoint(
        classes.select("class_id", "n", "shared").join(member, "class_id").groupBy("hub", "chunk").applyInPandas(_within(percent), "hub long, chunk int, class_id long, n long, shared binary, local long")
    )
    within = groups.where("class_id <> local").select(F.col("class_id").alias("u"), F.col("local").alias("v"))
    if groups.where(F.col("chunk") >= FEW_GROUPS).isEmpty():
        return within.unionByName(_compared(votes, groups.withColumn("inside", F.lit(None).cast("long")), percent))
    first = groups.where("chunk > 0").select(F.struct("hub", F.lit(0).alias("chunk")).alias("ga"), F.struct("hub", "chunk").alias("gb")).distinct()
    known = shared_checkpoint(within.unionByName(_sides(first, groups).groupBy("ga", "gb").applyInPandas(_between(percent), "u long, v long")))
    settled, apart = _settled(groups, known, percent)
    again = apart.where("class_id <> local").select(F.col("class_id").alias("u"), F.col("local").alias("v"))
    columns = [*groups.columns, "inside"]
    return known.unionByName(again).unionByName(_compared(votes, settled.select(columns).unionByName(apart.withColumn("inside", F.lit(None).cast("long")).select(columns)), percent))


def _sides(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of both groups of each pair (ga, gb)."""
    named = groups.withColumn("g", F.struct("hub", "chunk"))
    sides = [pairs.join(named, F.col("g") == F.col(own)).select("ga", "gb", F.lit(side).alias("side"), "class_id", "n", "shared", "local") for side, own in ((0, "ga"), (1, "gb"))]
    return sides[0].unionByName(sides[1])


def _settled(groups: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups whose classes lie in one component (``inside``; null in a hub's only
    group where they don't), and groups of the classes that lie apart from
    their group's main component, compared among themselves."""
    component = connected_components(known)
    placed = groups.join(component, groups["class_id"] == component["node"], "left").withColumn("local", F.coalesce("component", "class_id")).drop("node", "component")
    sizes = placed.groupBy("hub", "chunk", "local").agg(F.count("*").alias("n_local"))
    main = sizes.groupBy("hub", "chunk").agg(F.max_by("local", F.struct("n_local", "local")).alias("main"), F.count("*").alias("components"))
    several = groups.where("chunk > 0").select("hub").distinct().withColumn("several", F.lit(True))
    marked = shared_checkpoint(placed.join(main, ["hub", "chunk"]).join(several, "hub", "left").withColumn("apart", F.col("several").isNotNull() & (F.col("local") != F.col("main"))))
    whole = (F.col("components") == 1) | F.col("several").isNotNull()
    settled = marked.where("NOT apart").withColumn("inside", F.when(whole, F.col("main")))
    rest = marked.where("apart")
    parts = rest.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_CLASSES).alias("parts"))
    # groups of their own have negative numbers
    regrouped = rest.join(parts, "hub").withColumn("chunk", (-1 - F.pmod(F.xxhash64("class_id", F.lit(2)), F.col("parts"))).cast("int"))
    schema = "hub long, chunk int, class_id long, n long, shared binary, local long"
    return settled, shared_checkpoint(regrouped.select("hub", "chunk", "class_id", "n", "shared").groupBy("hub", "chunk").applyInPandas(_within(percent), schema))


def _compared(votes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links between groups that share a leading shingle and aren't inside one component."""
    cells = groups.select("class_id", F.struct("hub", "chunk").alias("g"), "inside")
    matrix = votes.select("class_id", "token").join(cells, "class_id").select("token", "g", "inside").distinct()
    new = F.col("a.inside").isNull() | F.col("b.inside").isNull() | (F.col("a.inside") != F.col("b.inside"))
    pairs = matrix.alias("a").join(matrix.alias("b"), F.col("a.token") == F.col("b.token")).where((F.col("a.g") < F.col("b.g")) & new).select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb")).distinct()
    return _sides(pairs, groups).groupBy("ga", "gb").applyInPandas(_between(percent), "u long, v long")


def link_documents(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    sets = shared_checkpoint(document_sets(docs, width, percent))
    key = ["n", "one", "two"]
    classes = sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    # one row of each class carries its shingles
    carried = sets.where("leading IS NOT NULL").groupBy(*key).agg(F.max_by(F.struct("shared", "leading"), "shared").alias("s")).join(classes, key)
    edges = class_links(carried.where("class_id IS NOT NULL").select("class_id", "n", "s.shared", "s.leading"), percent)
    component = connected_components(edges)
    of_class = classes.join(component, classes["class_id"] == component["node"], "left").select(*key, F.coalesce("component", "class_id").alias("component_id"))
    linked = sets.where("n > 0").select("doc_id", *key).join(of_class, key).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), 4, 85)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = w.doc_id
"""


def keep_one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows, all columns, of the smallest doc_id of each component (one without an
    id stands behind all others).  Each row is judged by its own text, with a null
    id or one that others have too; of rows with equal id and text one stays."""
    row, first = unused(docs, "row"), unused(docs, "first")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    linked = link_documents(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent)
    # both sides once: a hot row is one key of each
    member = linked.select(F.col("doc_id").alias(row), "component_id").distinct().join(keyed.select(row, F.col("doc_id").alias("id")).distinct(), row)
    heads = member.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("head")).select(F.col("head")[row].alias(row))
    numbered = keyed.join(heads, row, "left_semi").withColumn(first, F.row_number().over(Window.partitionBy(row, "doc_id").orderBy("text")))
    return numbered.where(F.col(first) == 1).select(docs.columns)
