"""Quality rules: text statistics and a decision list learned from labelled documents.

Statistics of a whole text (words are runs without ASCII white space): n_words, word_chars (code points in
words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line) and
n_repeat_words (words in 8-word windows found twice or more in the text, the first one included).

The list is learned by sequential covering. A rule that rejects is grown by the threshold with the best
information gain until it covers no good document, pruned from its end on other labelled documents, and kept
if its precision there is high enough; then what it covers is removed and the next one grown. The ordered
rules become one conditional expression of Spark. Without labels of both kinds the list is empty.

Null and empty texts have no words and fail the base rule; repeated documents are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import annotate, wrapped

SPACES, SYMBOLS, WINDOW = b" \t\n\r\x0b\x0c", b"#*$%&|<>", 8
STATS = ("_words", "_chars", "_symbols", "_dup_lines", "_repeats", "_lines")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) words that occur at least twice; exact, by ranks of doubled windows."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    step = 1
    while step < width:
        keys, rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        if len(keys) == len(rank):
            return 0
        step *= 2
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    points = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACES)))
    return len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of STATS."""

    def rows(texts: list[bytes | None]) -> list[pa.Array]:
        got = np.array([statistics(t) for t in texts], np.int64)
        return [pa.array(got[:, i]) for i in range(len(STATS))]

    return annotate(docs, "text", rows, ", ".join(f"{c} long" for c in STATS))


def base_failed() -> Column:
    return (F.col("_words") < 20) | (100 * F.col("_repeats") > 30 * F.col("_words"))


#: What rules test: a ratio of two statistics, free of the text's length.
FEATURES = {"symbols_per_word": ("_symbols", "_words"), "chars_per_word": ("_chars", "_words"), "duplicate_lines": ("_dup_lines", "_lines"), "repeated_words": ("_repeats", "_words"), "words_per_line": ("_words", "_lines")}


def _feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # greater or equal, else less
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        c = _feature(self.feature)
        return c >= self.threshold if self.above else c < self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < longest and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f in sorted(x):
            for t in np.unique(np.quantile(x[f][live], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    hit = live & Condition(f, above, float(t)).holds(x)
                    if p := (hit & bad).sum():
                        gain = p * (np.log2(p / hit.sum()) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, above, float(t)))
        if best[1] is None:
            break
        rule += (best[1],)
        live &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.9, support: int = 3, cuts: int = 64, longest: int = 4, rules: int = 12) -> list[Rule]:
    """Ordered rules that reject. ``prune`` marks the documents kept back for pruning; the rest grow rules."""
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(out) < rules:
        g, h = left & ~prune, left & prune
        if not (g & bad).any() or not (h & bad).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts, longest)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = h & _covered(rule[:k], x, len(bad))
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth.append((p - n) / max(p + n, 1))
        k = int(np.argmax(worth)) + 1
        hit = left & _covered(rule[:k], x, len(bad))
        held = hit & h
        if not (hit & bad).sum() >= support or (held & bad).sum() < precision * max(held.sum(), 1) or (hit & bad).sum() < precision * hit.sum():
            break
        out.append(rule[:k])
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Learn from about ``sample`` labelled documents at most, chosen by a hash of their ids; only their statistics come to the driver."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("quality").alias("_most")).filter("_quality = _most").drop("_most")
    n = known.count()
    if not n:
        return []
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    rows = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id")).select(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)).alias("fold"), "_quality", *[_feature(f).alias(f) for f in FEATURES], "_words", "_repeats").filter(~base_failed()).toPandas().sort_values(["fold", "_quality", *FEATURES])
    if rows["_quality"].nunique() < 2:
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["_quality"].to_numpy() == 0, rows["fold"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects (0: the base rule), null for a document to keep."""
    out = F.when(base_failed(), 0)
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, i)
    return out.otherwise(F.lit(None).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    v = verdict(fit(docs, labels))
    s = with_statistics(docs.select("doc_id", "text"))
    return s.select("doc_id", F.col("_words").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup_lines").alias("n_dup_lines"), F.col("_repeats").alias("n_repeat_words"), base_failed().alias("base_failed"), v.isNull().alias("kept"), v.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, columns as they were."""
    v = verdict(fit(docs, labels))
    return with_statistics(wrapped(docs)).filter(v.isNull()).select("_all.*")
