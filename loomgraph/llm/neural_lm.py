"""Language-model scores: a log-bilinear model of word classes, trained in numpy with noise-contrastive estimation.

Tokens are words (runs without white space, A-Z in lower case) and one end per text. How often each token occurs is counted over
all texts to learn from. The most frequent words are classes of their own, all others share classes by their last
bytes. The model predicts a token's class from the classes of the two tokens before it:

    s(w | u, v) = (r_u C1 + r_v C2) . q_w + b_w

Noise-contrastive estimation fits it on all texts, with the class frequencies of the whole corpus as noise: the first share of about ``share_tokens``
sets out, every share then goes on from there in a task of its own, and the mean by tokens is the model. Because a
context's score is a sum, exp(s) is a product, and one matrix product of exponentials gives the exact normaliser of every
context; a token's log-probability is then three look-ups. Within a shared class a word has its own count, less an absolute discount, and all
words that were never seen share the discounts, so probabilities sum to one over all known words and one unseen word per class.

Counts of the most frequent words (``head``, a fixed number) are broadcast; the other words of each text are joined
with the table of counts, which never leaves the executors. A text is split in bounded parts, never cut.

Defined cases: a null text is empty and has the end token only; a null doc_id is learned from; repeated rows count and are scored each;
without texts to learn from N = 0 and both scores are 0; more columns are ignored and may have any name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, stored

ENDINGS, LAST = 256, 3  # shared classes, and the last bytes of a word that name its class
BLOCK = 1 << 20  # bytes of a text that are split at once
TYPES = 1 << 18  # words that a counting task holds before it hands on its counts
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def held_out(folds: int = 10) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))


def word_blocks(text: bytes | None, block: int | None = None) -> Iterator[list[bytes]]:
    """A text's words in order, in lists of about ``block`` bytes of text."""
    low, at, block = (text or b"").lower(), 0, block or BLOCK
    while at < len(low):
        end = len(low) if at + block >= len(low) else min((x for x in (low.find(s, at + block) for s in SPACES) if x >= 0), default=len(low))
        yield low[at:end].split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """Words of all rows of ``docs`` (text) and how often they occur: w binary, c long. A task adds up before it sends."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "c"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for text in as_bytes(b.column(0).slice(at, 64)):
                    for words in word_blocks(text):
                        found.update(words)
                        if len(found) > TYPES:
                            yield out()
                            found.clear()
        if found:
            yield out()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def ending(w: bytes) -> int:
    return crc32(w[-LAST:]) % ENDINGS


def _ending(w: Column) -> Column:
    return F.pmod(F.crc32(F.when(F.length(w) > LAST, F.substring(w, -LAST, LAST)).otherwise(w)), F.lit(ENDINGS)).cast("int")


@dataclass
class Model:
    """What scoring needs beside the table of counts; its size hangs on parameters only."""

    n: int  # tokens learned from, ends included
    types: int  # different tokens learned from
    ends: int  # how many of them are ends
    classes: int  # the end (0), frequent words (1 ...), endings
    head: dict[bytes, int]  # frequent words' places in the next two
    head_count: np.ndarray
    head_class: np.ndarray
    seen: np.ndarray  # tokens in each ending's class
    kinds: np.ndarray  # words in each ending's class
    discount: float
    context: tuple[np.ndarray, np.ndarray] = ()  # classes by dimensions, for the token before and the one before that
    output: np.ndarray | None = None
    bias: np.ndarray | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def base(self, c: np.ndarray | float) -> np.ndarray:
        """log10 of smoothed unigram probabilities of tokens with counts ``c``."""
        return np.log10((np.asarray(c, float) + 0.1) / (self.n + 0.1 * (self.types + 1)))

    def within(self, c: np.ndarray, e: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with counts ``c`` within the classes of their endings ``e``."""
        seen, kinds = self.seen[e].astype(float), self.kinds[e]
        new = np.where(seen > 0, self.discount * kinds / np.maximum(seen, 1), 1.0)
        return np.log10(np.where(c > 0, (c - self.discount) / np.maximum(seen, 1), new))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural-log scores by (context, class) for both places, the bias in the first, and normalisers by (context, context)."""
        one, two = (c @ self.output.T for c in self.context)
        one = one + self.bias
        m1, m2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.exp(one - m1) @ np.exp(two - m2).T
        return one, two, np.log(z) + m1 + m2.T


_held: dict[str, tuple] = {}


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``model.tables()``, made once per worker."""
    if model.key not in _held:
        _held.clear()
        _held[model.key] = model.tables()
    return _held[model.key]


def classify(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Count (-1: not among the head) and class of each word."""
    at = np.fromiter(map(model.head.get, words, repeat(-1)), np.int64, len(words))
    count, cls = model.head_count[at], model.head_class[at]  # the last place is that of words not among the head
    others = np.flatnonzero(at < 0)
    if len(others):
        cls[others] = [ending(words[i]) for i in others.tolist()]
        cls[others] += model.classes - ENDINGS
    return count, cls


def train(lines: list[np.ndarray], classes: int, noise: np.ndarray, dims: int = 32, epochs: int = 3, rate: float = 0.2, batch: int = 1024, draws: int = 256, seed: int = 11, start: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Noise-contrastive estimation over sequences of classes (each begins after two ends): words, outputs, both mixes, biases, and their five sums of squares.

    Each batch meets ``draws`` classes drawn from ``noise``; AdaGrad steps. ``start`` is what an earlier call gave, to go on from.
    """
    r = np.random.default_rng(seed)
    p = (noise + 0.5) / (noise + 0.5).sum()
    log_kp = np.log(draws * p).astype(np.float32)
    if start is None:
        word, out = (r.normal(0, 0.1, (classes, dims)).astype(np.float32) for _ in range(2))
        mix = [np.eye(dims, dtype=np.float32) for _ in range(2)]
        bias = np.log(p).astype(np.float32)
        squares = [np.full_like(x, 1e-6) for x in (word, out, *mix, bias)]
    else:
        word, out, *mix, bias = (x.copy() for x in start[:5])
        squares = [x.copy() for x in start[5:]]
    line = np.concatenate([np.concatenate([[0, 0], x]) for x in lines]) if lines else np.zeros(0, np.int64)
    real = np.ones(len(line), bool)
    starts = np.cumsum([0, *(len(x) + 2 for x in lines)])[:-1]
    real[starts], real[starts + 1] = False, False
    at = np.flatnonzero(real)
    target, u, v = line[at], line[at - 1], line[at - 2]

    def step(which: int, x: np.ndarray, g: np.ndarray) -> None:
        squares[which] += g * g
        x += rate * g / np.sqrt(squares[which])

    places = np.arange(dims)

    def by_class(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Per class the sum of the rows of ``g`` that are its own."""
        at = (rows * dims)[:, None] + places
        return np.bincount(at.ravel(), g.ravel(), classes * dims).reshape(classes, dims).astype(np.float32)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        """1 / (1 + exp(x)), in the place of ``x``: fresh pages cost more than the sum."""
        np.exp(x, out=x)
        x += 1
        return np.divide(1, x, out=x)

    cumulative = np.cumsum(p)
    for _ in range(epochs):
        order = r.permutation(len(target))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            t, a, c = target[own], u[own], v[own]
            k = np.searchsorted(cumulative, r.random(draws)).clip(0, classes - 1)
            h = (word @ mix[0]).take(a, 0)  # classes are fewer than tokens
            h += (word @ mix[1]).take(c, 0)
            true, noisy = out.take(t, 0), out.take(k, 0)
            up = sigmoid(np.einsum("ij,ij->i", h, true) + (bias - log_kp)[t])  # the gradient of a true token's score
            down = h @ noisy.T
            down += (bias - log_kp)[k]
            down = sigmoid(np.negative(down, out=down))  # the score of noise goes down by it
            true *= up[:, None]
            gh = true
            gh -= down @ noisy
            one, two = by_class(a, gh), by_class(c, gh)
            g_mix = [word.T @ one, word.T @ two]
            g_word = one @ mix[0].T + two @ mix[1].T
            noise_up = down.T @ h
            h *= up[:, None]
            h_up = by_class(t, h)
            np.subtract.at(h_up, k, noise_up)
            bias_up = np.bincount(t, up, classes) - np.bincount(k, down.sum(0), classes)
            step(1, out, h_up)
            step(4, bias, bias_up.astype(np.float32))
            step(0, word, g_word)
            for i in range(2):
                step(2 + i, mix[i], g_mix[i])
    return [word, out, *mix, bias, *squares]


def shares(docs: DataFrame, model: Model, number: int, stretch: int = 500) -> DataFrame:
    """The class sequences of all texts, in stretches, dealt to ``number`` shares: share, line, n (how often). Equal stretches are counted and their
    copies dealt in turn, so that neither the order of rows nor a text that comes very often tells on a share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rest = np.zeros(0, np.int64)
                for words in chain(word_blocks(as_bytes(b.column(0).slice(i, 1))[0]), [None]):
                    rest = np.concatenate([rest, [0] if words is None else classify(words, shared.value)[1]])
                    cut = len(rest) if words is None else len(rest) // stretch * stretch
                    yield pa.RecordBatch.from_arrays([pa.array([rest[at : min(at + stretch, cut)].astype("<i4").tobytes() for at in range(0, cut, stretch)], pa.binary())], ["line"])
                    rest = rest[cut:]

    lines = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "line binary").groupBy("line").agg(F.count("*").alias("c"))
    turn = F.explode(F.sequence(F.lit(0), F.least(F.col("c"), F.lit(number)).cast("int") - 1)).alias("k")
    dealt = lines.select("line", "c", turn).withColumn("n", F.floor((F.col("c") - F.col("k") + number - 1) / number))
    return dealt.select(F.pmod(F.xxhash64("line") + F.col("k"), F.lit(number)).cast("int").alias("share"), "line", "n")


def _sequences(lines: list[bytes], times: list[int]) -> list[np.ndarray]:
    """In an order that hangs on the lines alone."""
    return [np.frombuffer(x, "<i4").astype(np.int64) for x, n in sorted(zip(lines, times, strict=True)) for _ in range(n)]


def learned(docs: DataFrame, model: Model, noise: np.ndarray, share_tokens: int, dims: int, epochs: int) -> list[np.ndarray]:
    """Words, outputs, mixes and biases learned from all of ``docs``. A share goes over its lines once, from where the first share came in ``epochs``."""
    number = -(-model.n // share_tokens)
    dealt = shares(docs, model, number)
    dealt = stored(dealt, "lines") if number > 1 else dealt
    first = dealt.filter("share = 0").toArrow()  # about ``share_tokens`` tokens
    start = train(_sequences(first["line"].to_pylist(), first["n"].to_pylist()), model.classes, noise, dims, epochs)
    if number == 1:
        return start[:5]
    shared, classes = docs.sparkSession.sparkContext.broadcast((start, noise)), model.classes

    def go_on(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, own = shared.value
        lines = _sequences(list(pdf["line"]), list(pdf["n"]))
        state = train(lines, classes, own, dims, 1, batch=8192, draws=64, seed=int(pdf["share"].iloc[0]), start=begin)
        return pd.DataFrame({"tokens": [sum(map(len, lines))], "state": [np.concatenate([x.ravel() for x in state[:5]]).astype("<f4").tobytes()]})

    parts = dealt.groupBy("share").applyInPandas(go_on, "tokens long, state binary")
    total, tokens = parts.rdd.map(lambda r: (np.frombuffer(r.state, "<f4").astype(float) * r.tokens, r.tokens)).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))  # one state's size, whatever the number of shares
    cuts = np.cumsum([x.size for x in start[:5]])[:-1]
    return [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(total / tokens, cuts), start[:5], strict=True)]


def fit(docs: DataFrame, frequent: int = 2048, head: int = 1 << 17, share_tokens: int = 2_000_000, dims: int = 32, epochs: int = 3) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs`` (doc_id, text), and its table of counts (w, c)."""
    counts = stored(word_counts(docs), "counts")
    ends = docs.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "w").limit(head).toArrow()  # ``head`` rows at most
    listed = list(zip(top["w"].to_pylist(), top["c"].to_pylist(), strict=True))
    frequent = min(frequent, len(listed))
    classes = 1 + frequent + ENDINGS
    head_count = np.array([*(c for _, c in listed), -1], np.int64)
    head_class = np.array([*(i + 1 if i < frequent else classes - ENDINGS + ending(w) for i, (w, _) in enumerate(listed)), 0], np.int64)
    seen, types = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    once = twice = 0
    for e, n, k, n1, n2 in counts.groupBy(_ending(F.col("w")).alias("e")).agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).collect():  # a row per ending
        seen[e], types[e], once, twice = n, k, once + n1, twice + n2
    for w, c in listed[:frequent]:
        seen[ending(w)] -= c
        types[ending(w)] -= 1
    model = Model(words + ends, kinds + (ends > 0), ends, classes, {w: i for i, (w, _) in enumerate(listed)}, head_count, head_class, seen, types, once / (once + 2 * twice) if once else 0.5)
    if not model.n:
        return model, counts
    noise = np.concatenate([[ends], [c for _, c in listed[:frequent]], seen])
    word, model.output, one, two, model.bias = learned(docs, model, noise.astype(float), share_tokens, dims, epochs)
    model.context = (word @ one, word @ two)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, folds: int = 10) -> DataFrame:
    """Each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (sums of log10)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, own double, rare array<struct<w:binary,n:int>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, first = shared.value, TaskContext.get().partitionId() << 33
        one, two, z = _tables(m)
        start = m.classes - ENDINGS
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, rows = b.slice(at, 64), []
                for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    n, known, base, own, rare, before = 0, 0, 0.0, 0.0, Counter(), np.zeros(2, np.int64)
                    for words in chain(word_blocks(text), [None]):
                        count, cls = (np.array([m.ends]), np.zeros(1, np.int64)) if words is None else classify(words, m)
                        line = np.concatenate([before, cls])
                        before = line[-2:]
                        n += len(cls)
                        own += float((one[line[1:-1], cls] + two[line[:-2], cls] - z[line[1:-1], line[:-2]]).sum(dtype=float)) / np.log(10)
                        listed = count >= 0
                        known += int((count > 0).sum())
                        base += float(m.base(count[listed]).sum())
                        shares = listed & (cls >= start)
                        own += float(m.within(count[shares], cls[shares] - start).sum())
                        if words is not None:
                            rare.update([words[i] for i in np.flatnonzero(~listed).tolist()])
                    rows.append((first, doc_id, n, known, base, own, [{"w": w, "n": k} for w, k in rare.items()]))
                    first += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "n_tokens", "n_known", "base", "own", "rare"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = ["doc_id", held_out(folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens")]
    if not model.n:
        blank = own.mapInArrow(_lengths, "doc_id long, n_tokens long").withColumn("n_known", F.lit(0).cast("long"))
        return blank.select(*names, F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    rows = stored(own.mapInArrow(run, schema), "scored")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.n").join(counts, "w", "left")
    c, e = F.coalesce(F.col("c"), F.lit(0)), _ending(F.col("w"))
    base = F.log10((c + F.lit(0.1)) / F.lit(model.n + 0.1 * (model.types + 1)))
    seen, kinds = (F.array(*[F.lit(float(x)) for x in a])[e] for a in (model.seen, model.kinds))
    new = F.when(seen > 0, F.lit(model.discount) * kinds / seen).otherwise(1.0)
    inside = F.log10(F.when(c > 0, (c - F.lit(model.discount)) / seen).otherwise(new))
    sums = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * inside).alias("o"))
    j = rows.drop("rare").join(sums, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0)))
    return j.select(*names, (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("o", F.lit(0.0))).alias("score"))


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1 + sum(map(len, word_blocks(t))) for t in as_bytes(b.column(1))], pa.int64())], ["doc_id", "n_tokens"])


def report(docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those that are not held out."""
    model, counts = fit(docs.filter(~held_out()))
    return score(docs, model, counts)
