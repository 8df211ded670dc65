"""Benchmark decontamination by suffix arrays over shards of the corpus.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A task joins
documents into shards of about a million words and builds each shard's suffix array once, in order of as many words as a
window has; suffixes that can't match for words that no item has are left out. Every window of every test suffix is looked up in it by binary search,
which gives the range of all its places. From each place the match is followed to its end, against the neighbours in the
suffix array of the items themselves: the longest verbatim match and where it lies on both sides.
Windows are ``width`` consecutive words of an item; an item of fewer, but not none, is one window.

The test items are not broadcast: they lie in the shared folder in blocks of a bounded size, and a shard is searched
for one block after another, so their number has no limit.

Null and empty texts have no words and are never hit; repeated documents are judged alike; no items: no hits;
rows of one item_id are one item; items without an id hit like others, but are not named or counted.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import annotate, work_dir, wrapped

SHARD_WORDS = 1_000_000


def _table() -> bytes:
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    return bytes(c if c >= 128 or c in keep else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


TABLE = _table()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` codes from there on (to the next power of two), by doubling; past the end counts least."""
    rank = np.unique(codes, return_inverse=True)[1] + 1
    size = 1
    while size < depth and len(codes):
        key = rank * (int(rank.max()) + 1)
        key[:-size] += rank[size:] if size < len(rank) else 0
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(new)
        size *= 2
        if rank[order[-1]] == len(codes):
            break
    return np.argsort(rank, kind="stable")


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length, up to ``most``, of what ``a`` from ``at`` on and ``b`` from ``bt`` on have in common, pair by pair."""
    n = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        i, j = at[live] + n[live], bt[live] + n[live]
        same = (i < len(a)) & (j < len(b)) & (n[live] < most[live])
        live = live[same]
        live = live[a[i[same]] == b[j[same]]]
        n[live] += 1
    return n


def search(array: np.ndarray, codes: np.ndarray, other: np.ndarray, at: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """Where in ``array`` (of ``codes``) the first ``most`` codes from each ``at`` of ``other`` belong: before, or ``after``, the suffixes that start with them."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array))
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        n = common(codes, array[mid], other, at[live], most[live])
        i, j = array[mid] + n, at[live] + n
        full = n == most[live]
        mine = np.where(i < len(codes), codes[np.minimum(i, len(codes) - 1)], -1)
        less = np.where(full, after, mine < other[np.minimum(j, len(other) - 1)])
        low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
    return low


class Block:
    """Some items' words, one item after another with a zero between, the windows to look up, and how far each suffix's item reaches."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int) -> None:
        self.items, self.words, self.item, self.place, left, at, size = [i for i, _ in items], [], [], [], [], [], []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            m = min(width, len(words))
            at += range(len(self.words), len(self.words) + len(words) - m + 1) if m else []
            size += [m] * (len(words) - m + 1 if m else 0)
            self.words += [*words, b""]
            self.item += [k] * (len(words) + 1)
            self.place += range(len(words) + 1)
            left += range(len(words), -1, -1)
        self.left, self.at, self.size = np.array(left, np.int64), np.array(at, np.int64), np.array(size, np.int64)
        self.item, self.place = np.array(self.item, np.int64), np.array(self.place, np.int64)


@lru_cache(maxsize=16)
def _block(path: str, width: int) -> Block:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    t = pq.read_table(at, filesystem=system)
    return Block(list(zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True)), width)


@lru_cache(maxsize=1)
def _vocabulary(path: str, width: int) -> tuple[dict[bytes, int], int]:
    """Numbers, from one, of all words of all items, and the length of the shortest window."""
    code: dict[bytes, int] = {}
    least = width
    for f in _files(path):
        block = _block(f, width)
        for w in block.words:
            if w:
                code.setdefault(w, len(code) + 1)
        least = min(least, int(block.size.min()) if len(block.size) else width)
    return code, least


@lru_cache(maxsize=4)
def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    head = path[: path.index(at)] if at in path else ""
    return sorted(head + x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet"))


class Shard:
    """Documents' words as codes, one document after another with a zero between, and their suffix array in order of ``width`` words.

    ``code`` numbers the words of all items; others are zero. A suffix with fewer of them in a row than the shortest window (``least``) can't match and is left out.
    """

    def __init__(self, docs: list[list[bytes]], width: int, code: dict[bytes, int], least: int) -> None:
        self.code, get = code, code.get
        flat: list[int] = []
        self.starts = []
        for words in docs:
            self.starts.append(len(flat))
            flat += [get(w, 0) for w in words]
            flat.append(0)
        self.starts = np.array(self.starts, np.int64)
        self.codes = np.array(flat, np.int64)
        zeros = np.flatnonzero(self.codes == 0)
        run = zeros[np.searchsorted(zeros, np.arange(len(flat)))] - np.arange(len(flat))  # words up to the next zero
        at = np.flatnonzero(run >= max(least, 1))
        rows = np.append(self.codes, np.zeros(width, np.int64))[at[:, None] + np.arange(width)].astype(">u4")
        self.array = at[np.argsort(np.ascontiguousarray(rows).view(f"S{4 * width}").ravel(), kind="stable")]

    def matches(self, block: Block) -> tuple[np.ndarray, ...]:
        """Of every occurrence of a window: its place, its length, and the window's number; a window that several items have counts once.

        Then, of every such place, the longest match with any item: place, length and the suffix of the block.
        """
        none = (np.empty(0, np.int64),) * 6
        if not len(block.at):
            return none
        code = self.code.get
        other = np.array([code(w, 0) for w in block.words], np.int64)
        use, at, size = np.arange(len(block.at)), block.at, block.size
        low = search(self.array, self.codes, other, at, size, False)
        high = search(self.array, self.codes, other, at, size, True)
        use, first, size, low, high = use[high > low], low[high > low], size[high > low], low[high > low], high[high > low]
        if not len(use):
            return none
        # of windows with one range the first stands for all; the items of each are kept
        _, alone = np.unique(np.stack([low, high, size]), axis=1, return_index=True)
        n = high[alone] - low[alone]
        places = self.array[np.repeat(low[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        lengths, number = np.repeat(size[alone], n), np.repeat(alone, n)
        self.same: dict[int, list[int]] = defaultdict(list)
        head = {tuple(k): i for i, k in zip(alone.tolist(), zip(low[alone].tolist(), high[alone].tolist(), size[alone].tolist(), strict=True), strict=True)}
        for w, k in zip(use.tolist(), zip(low.tolist(), high.tolist(), size.tolist(), strict=True), strict=True):
            self.same[head[k]].append(int(block.item[block.at[w]]))
        # the places' longest matches, from their neighbours in the items' own array
        where = np.unique(places)
        array = suffix_array(other, int(block.left.max()))
        array = array[block.left[array] > 0]
        far = np.full(len(where), int(block.left.max()))
        pos = search(array, other, self.codes, where, far, False)
        best, suffix = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        for d in (-1, 0):
            near = np.clip(pos + d, 0, len(array) - 1)
            got = common(other, array[near], self.codes, where, block.left[array[near]])
            best, suffix = np.maximum(best, got), np.where(got > best, array[near], suffix)
        return places, lengths, number, where, best, suffix


def _shards(texts: list[bytes | None]):
    docs, n = [], 0
    for t in texts:
        docs.append(words_of(t))
        n += len(docs[-1])
        if n >= SHARD_WORDS:
            yield docs
            docs, n = [], 0
    if docs:
        yield docs


def judge(texts: list[bytes | None], path: str, width: int) -> list[tuple]:
    """Of each text: words, words hit, sorted ids of the items found, and the longest verbatim match: words, place, item, place in the item."""
    out = []
    for docs in _shards(texts):
        shard = Shard(docs, width, *_vocabulary(path, width))
        cover = np.zeros(len(shard.codes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in docs]
        longest: list[tuple] = [(0, None, None, None)] * len(docs)
        for f in _files(path):
            block = _block(f, width)
            places, lengths, number, where, best, suffix = shard.matches(block)
            if not len(places):
                continue
            cover += np.bincount(places, minlength=len(cover)) - np.bincount(places + lengths, minlength=len(cover))
            doc = np.searchsorted(shard.starts, places, "right") - 1
            for d, w in np.unique(np.stack([doc, number]), axis=1).T.tolist():
                items[d].update(block.items[i] for i in shard.same[w] if block.items[i] is not None)
            doc = np.searchsorted(shard.starts, where, "right") - 1
            order = np.lexsort((where, -best, doc))
            for i in order[np.append(True, doc[order][1:] != doc[order][:-1])].tolist():
                d, t = int(doc[i]), int(suffix[i])
                if best[i] > longest[d][0]:
                    longest[d] = (int(best[i]), int(where[i] - shard.starts[d]), block.items[block.item[t]], int(block.place[t]))
        hit = np.append(0, np.cumsum(np.cumsum(cover) > 0))
        out += [(len(w), int(hit[s + len(w)] - hit[s]), sorted(i), *x) for w, s, i, x in zip(docs, shard.starts.tolist(), items, longest, strict=True)]
    return out


def store_benchmark(bench: DataFrame, block_bytes: int = 8_000_000) -> str:
    """Write the items to the shared folder in blocks of about ``block_bytes``; return the folder."""
    own = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    path = work_dir(bench.sparkSession, "benchmark")
    own.repartition(max(1, -(-size // block_bytes))).write.parquet(path)
    return path


ADDED = "_n_words long, _n_hit long, _items array<string>, _longest long, _at long, _item string, _item_at long"


def annotated(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` with _n_words, _n_hit, _items and the longest match: _longest (words), _at (its place), _item, _item_at."""
    path = store_benchmark(bench)

    def found(texts: list[bytes | None]) -> list[pa.Array]:
        rows = judge(texts, path, width)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]

    return annotate(docs, "text", found, ADDED, rows=2048)


def report(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and its longest match with an item, if it holds a window of one: longest_match, match_at, match_item, match_item_at (in words)."""
    a = annotated(docs.select("doc_id", "text"), bench, width)
    return a.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"), F.col("_longest").alias("longest_match"), F.col("_at").alias("match_at"), F.col("_item").alias("match_item"), F.col("_item_at").alias("match_item_at"))


def clean(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a hit, columns as they were."""
    return annotated(wrapped(docs), bench, width).filter("_n_hit = 0").select("_all.*")
