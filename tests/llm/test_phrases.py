"""Phrase collocations against counting by dictionaries."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from veltrial.llm.phrases import Encoded, PerfectHash, collocations, encode, scores


def plain(rows, min_count, max_words, top, covered):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f.update((lang, ws[i : i + k]) for i in range(len(ws) - k + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = []
    for (lang, ws), a in cands.items():
        best = None
        for k in range(1, len(ws)):
            l, r = f[lang, ws[:k]], f[lang, ws[k:]]
            s = int(Fraction(1_000_000 * a * a, l * r))
            if best is None or s < best[0]:
                best = (s, l, r)
        inside = any(m == lang and len(longer) > len(ws) and 100 * b >= covered * a and any(longer[i : i + len(ws)] == ws for i in range(len(longer) - len(ws) + 1)) for (m, longer), b in cands.items())
        if not inside:
            out.append((lang, best[0], a, " ".join(ws), best[1], best[2], n[lang]))
    result = []
    for lang in n:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        result += [(lang, i + 1, p, a, l, r, m, s) for i, (_, s, a, p, l, r, m) in enumerate(own)]
    return sorted(result)


def made(seed, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "été", "Straße", "x", "the", "of", "9", "ＡＢ", " nbsp", "İ", "á"]
    joins = [" ", "  ", "\t", ". ", ", ", "\n", ":", "! ", " ", " ", " "]
    rows = []
    for i in range(docs):
        size = int(rng.integers(0, 60))
        text = "".join(vocabulary[rng.integers(len(vocabulary))] + joins[rng.integers(len(joins))] for _ in range(size))
        rows.append((text if i % 17 else None, [None, "en", "de", "und"][i % 4]))
    return rows + [("the of New York city " * 400, "en"), ("", "xx"), (" \t.,", "yy")]


@pytest.mark.parametrize("limits", [{}, {"block_keys": 50}, {"bits": 9}, {"bits": 6, "block_keys": 10}], ids=["one pass", "many passes", "collisions", "both"])
@pytest.mark.parametrize("words,count", [(3, 10), (4, 3)])
def test_equals_plain_counting(spark, limits, words, count):
    rows = made(words)
    df = spark.createDataFrame([(t, g, i, "clash") for i, (t, g) in enumerate(rows)], "text string, lang string, bucket long, phrase string").repartition(3)
    got = collocations(df, min_count=count, max_words=words, top=40, **limits).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == plain(rows, count, words, 40, 50)


def test_empty_and_wordless_tables(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("..", "en")], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([("one two", "en")], "text string, lang string")).collect() == []


def test_a_long_text_is_cut_between_pieces_only(spark):
    text = "alpha beta gamma. " * 600_000 + "no break " * 200_000  # 13 MB, its end one piece
    got = {(r["phrase"]): r["a"] for r in collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), covered=1000).collect()}
    assert got["alpha beta"] == 600_000 and got["alpha beta gamma"] == 600_000
    assert got["no break"] == 200_000 and got["break no"] == 199_999 and "gamma alpha" not in got


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert len(PerfectHash(keys[:0]).slots(keys)) == len(keys) and (PerfectHash(keys[:0]).slots(keys) == -1).all()


def test_scores_pass_64_bits():
    a = np.array([3_000_000_000_000, 10])
    l, r, s = scores(a, np.array([2, 3]), np.array([[4_000_000_000_000, 3_000_000_000_001, -1, -1], [20, 10, 10, 20]]))
    assert s.tolist() == [int(Fraction(10**6 * int(a[0]) ** 2, 4_000_000_000_000 * 3_000_000_000_001)), 500_000] and l.tolist()[1] == 20


def test_encoding_keeps_words_and_breaks():
    text = encode("en", np.frombuffer("The CAT.the\tcat x\n".encode(), np.uint8))
    assert isinstance(text, Encoded)
    assert [b"" if i < 0 else text.word(i) for i in text.ids] == [b"the", b"cat", b"", b"the", "cat x".encode()]
