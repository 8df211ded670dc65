"""The language model: counts and base scores against a plain version, probabilities that sum to one, learning on held-out text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import neural_lm as N

SCHEMA = "doc_id long, text string, w string, c long, row string, base double, rare string"
R = random.Random(11)
WORDS = {k: [f"{R.choice('abcd' if k else 'wxyz')}{R.choice('aeiou')}{i}" for i in range(300)] for k in (0, 1)}


def prose(n):
    own = WORDS[R.random() < 0.5]
    return " ".join(own[min(int(R.expovariate(0.05)), 299)] for _ in range(n))


TEXTS = [prose(R.randint(1, 120)) for _ in range(160)] + [None, "", " \t\n\x0b", "É Ünï ÀB ab c", "word " * 2000, prose(9000), "solo" * 3000]
ROWS = [*enumerate(TEXTS), (None, "no id"), (3, TEXTS[3]), (3, TEXTS[3])]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "r", 0.5, "x") for i, t in rows], SCHEMA)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")) + [None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain(rows):
    c = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)) for i, x in rows for t in [tokens(x)]), key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_counts_and_base_equal_a_plain_version(spark, parts):
    docs = table(spark, ROWS).repartition(parts)
    model, counts = N.fit(docs.filter(~N.held_out()), frequent=20, head=60, epochs=1)
    got = N.score(docs, model, counts).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert sorted(((*r[:5], round(r.base_score, 4)) for r in got), key=str) == plain(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.fixture(scope="module")
def fitted(spark):
    return N.fit(table(spark, ROWS).filter(~N.held_out()), frequent=50, head=100)


def test_scores_equal_a_plain_model_and_sum_to_one(spark, fitted):
    model, counts = fitted
    c = {bytes(r.w): r.c for r in counts.collect()}
    first = model.classes - N.ENDINGS
    frequent = {w: i + 1 for w, i in model.head.items() if i < first - 1}

    def cls(w):
        return 0 if w is None else frequent.get(w, first + N.ending(w))

    def log_p(u, v):
        s = np.array([model.context[0][u] @ q + model.context[1][v] @ q + b for q, b in zip(model.output, model.bias)], float)
        return s - np.log(np.exp(s - s.max()).sum()) - s.max()

    def score(text):
        total, u, v = 0.0, 0, 0
        for t in tokens(text):
            w = None if t is None else t.encode()
            k = cls(w)
            total += log_p(u, v)[k] / np.log(10)
            if k >= first:
                e, n = k - first, c.get(w, 0)
                total += math.log10((n - model.discount) / model.seen[e] if n else model.discount * model.kinds[e] / model.seen[e] if model.seen[e] else 1)
            u, v = k, u
        return total

    short = [(i, t) for i, t in ROWS if len(t or "") < 300] + [(900, "never seen wörds of any kind"), (901, "zz9 a")]
    got = N.score(table(spark, short), model, counts).collect()
    expected = {}
    for i, t in short:
        expected.setdefault(i, []).append(round(score(t), 3))
    assert len(got) == len(short) and all(min(abs(r.score - x) for x in expected[r.doc_id]) < 2e-2 + 1e-4 * abs(r.score) for r in got)

    one, two, z = model.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None]).sum(2)
    assert np.abs(p - 1).max() < 1e-3
    within = Counter()
    for w, n in c.items():
        if w not in frequent:
            within[N.ending(w)] += (n - model.discount) / model.seen[N.ending(w)]
    for e in range(N.ENDINGS):
        unseen = model.discount * model.kinds[e] / model.seen[e] if model.seen[e] else 1
        assert abs(within[e] + unseen - 1) < 1e-9


def test_held_out_text_scores_better_than_by_the_unigram(spark):
    rows = [(i, prose(80)) for i in range(700)]
    got = N.report(table(spark, rows)).filter("held_out").collect()
    assert len(got) > 40 and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_result_does_not_hang_on_partitions(spark):
    rows = [(i, prose(40)) for i in range(120)]
    a, b = (sorted((r.doc_id, round(r.score, 4)) for r in N.report(table(spark, rows).repartition(p)).collect()) for p in (1, 8))
    assert a == b


def test_nothing_to_learn_from(spark):
    rows = [(i, "some text") for i in range(300) if out(i)]
    got = N.report(table(spark, rows)).collect()
    assert len(got) == len(rows) > 5 and {tuple(r[1:]) for r in got} == {(True, 3, 0, 0, 0.0, 0.0)}
    assert N.report(table(spark, rows).limit(0)).count() == 0
    blank = N.report(table(spark, [(1, None), (2, "")])).collect()
    assert all(r[2:5] == (1, 1, 2) and abs(r.base_score - math.log10(2.1 / 2.2)) < 1e-9 for r in blank) and len(blank) == 2


def test_blocks_split_no_word():
    text = (" ".join(WORDS[0]) + "\n\t x" * 30).encode()
    assert [w for b in N.word_blocks(text, 16) for w in b] == text.split()


def test_endings_are_alike_in_spark(spark):
    from pyspark.sql import functions as F

    words = ["", "a", "ab", "abc", "abcd", "été", "日本語", "x" * 90]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", N._ending(F.col("w").cast("binary")).alias("e")).collect()
    assert all(r.e == N.ending(r.w.encode()) for r in got)


def test_every_text_is_learned_from(spark):
    rows = [(i, prose(120)) for i in range(60)] + [(100 + i, "same words again") for i in range(50)] + [(900, prose(1300))]
    docs = table(spark, rows)
    model, _ = N.fit(docs, frequent=50, head=100, epochs=1)
    for number in (1, 3):
        got = N.shares(docs, model, number).collect()
        assert sum(len(r.line) // 4 * r.n for r in got) == model.n == sum(len(tokens(t)) for _, t in rows)
        assert {r.share for r in got} == set(range(number))
    a, b = (N.fit(table(spark, rows).repartition(p), frequent=50, head=100, epochs=1, share_tokens=2500)[0] for p in (1, 5))
    assert np.allclose(a.output, b.output, atol=1e-5) and np.isfinite(a.output).all()
    one, two, z = a.tables()
    assert np.abs(np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None]).sum(2) - 1).max() < 1e-3
    other = N.fit(table(spark, [(i, t if i != 900 else " ".join(reversed(t.split()))) for i, t in rows]), frequent=50, head=100, epochs=1, share_tokens=2500)[0]
    assert not np.allclose(a.output, other.output, atol=1e-5)  # the same counts, another order of words in one text


def test_a_step_adds_up_what_single_tokens_add():
    """One batch against gradients added token by token; places at a line's start aren't learned."""
    r = np.random.default_rng(4)
    lines, classes, draws, rate = [r.integers(0, 7, n) for n in (5, 1, 0, 9)], 7, 6, 0.2
    noise = np.bincount(np.concatenate(lines), minlength=classes).astype(float)
    begin = N.train([], classes, noise, 4)
    begin[5:] = [x + 1 for x in begin[5:]]
    got = N.train(lines, classes, noise, 4, 1, rate, 1024, draws, 3, begin)
    word, out, one, two, bias = (x.astype(float) for x in begin[:5])
    g = [np.zeros_like(x) for x in (word, out, one, two, bias)]
    own = np.random.default_rng(3)
    p = (noise + 0.5) / (noise + 0.5).sum()
    own.permutation(sum(map(len, lines)))
    k = np.searchsorted(np.cumsum(p), own.random(draws)).clip(0, classes - 1)
    for x in lines:
        row = [0, 0, *x.tolist()]
        for c, a, t in zip(row, row[1:], row[2:]):
            h = word[a] @ one + word[c] @ two
            gh = np.zeros(4)
            for w, sign in [(t, 1), *((i, -1) for i in k)]:
                e = sign / (1 + np.exp(sign * (h @ out[w] + bias[w] - np.log(draws * p[w]))))
                g[1][w] += e * h
                g[4][w] += e
                gh += e * out[w]
            g[0][a] += one @ gh
            g[0][c] += two @ gh
            g[2] += np.outer(word[a], gh)
            g[3] += np.outer(word[c], gh)
    for x, y, d, s in zip(got, begin, g, begin[5:]):
        assert np.allclose(x, y + rate * d / np.sqrt(s + d * d), atol=1e-5)
