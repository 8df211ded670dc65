"""Importance resampling against a plain version and its oracle's cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import importance as I

SCHEMA = "doc_id long, text string, _all string, _words long, weight long, rank string, n long"
R = random.Random(12)
VOCAB = ["".join(R.choice("abcdeXÖé日7") for _ in range(R.randint(1, 5))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCAB) + R.choice(["", ",", ".", "\n", "'"]) for _ in range(n))


TEXTS = [prose(R.randint(0, 60)) for _ in range(150)] + [None, "", " .\t", "A-b_c", "x " * 30, "x " * 30, prose(30_000), "ÀB c" * 20]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, percent=10, min_words=20, n=1):
    own = [(i, *plain_features(t, n)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x, n)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words))
    long_enough = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = long_enough[: percent * len(long_enough) // 100]
    ranks = {}
    for k, x in enumerate(drawn, 1):
        ranks.setdefault(x[:4], []).append(k)
    return sorted(((*x[:4], ranks[x[:4]].pop(0) if x[4] and ranks.get(x[:4]) else None) for x in out), key=str)


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (None, prose(40)), (None, None), (4, TEXTS[4]), (4, TEXTS[4]), (-5, prose(25))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2, "r", 3) for i, t in rows], SCHEMA)


TARGET = [prose(50), None, "", VOCAB[0] + " " + VOCAB[1]]


def ranked(docs, target, percent=10, n=1):
    got = I.ranks(docs, I.fit(docs, target, n), percent, n=n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n, percent, parts", [(1, 10, 1), (1, 35, 9), (3, 50, 3), (1, 100, 4)])
def test_ranks_equal_a_plain_version(spark, docs, rows, n, percent, parts):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    assert ranked(docs.repartition(parts), target, percent, n) == plain(rows, TARGET, percent, n=n)


def test_ties_and_repeated_rows_take_different_ranks(spark):
    rows = [(1, "b " * 25)] * 7 + [(2, "b " * 25)] * 7
    got = ranked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), 50)
    assert got == plain(rows, [], 50) and sorted(r[4] for r in got if r[4]) == list(range(1, 8))


def test_empty_tables_and_no_draw(spark, docs):
    none = docs.limit(0)
    assert ranked(none, none) == []
    assert {r[4] for r in ranked(docs, none, 0)} == {None}
    assert I.draw(docs, I.fit(docs, none), 0).count() == 0


def test_drawn_documents_keep_their_columns(spark, docs):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    gain = I.fit(docs, target)
    drawn = I.draw(docs, gain, 20)
    ids = sorted((r.doc_id or -9) for r in I.ranks(docs, gain, 20).filter("rank is not null").collect())
    assert drawn.columns == docs.columns and sorted((r.doc_id or -9) for r in drawn.collect()) == ids and ids


def test_blocks_split_no_word_and_no_run():
    text = prose(4000).encode()
    words = [w for block in I.word_blocks(text, 64) for w in block]
    assert words == [w.encode() for w in plain_features(text.decode(), 1)[0]]
    block, I.word_blocks = I.word_blocks, lambda t: block(t, 64)
    try:
        count = np.zeros(1, np.int64)
        got = np.concatenate([b for _, b in I.features([text], 3, count)])
    finally:
        I.word_blocks = block
    assert Counter(got.tolist()) == Counter(plain_features(text.decode(), 3)[1]) and count[0] == len(words)
