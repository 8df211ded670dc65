"""Tokens of whole texts by a public vocabulary file, each distinct word encoded once per worker.

The vocabulary's normaliser and splitter never join characters across ASCII white space, so a text's
ids are its words' ids in order. Words seen before come from a bounded memory. Texts that hold the literal of
a special token go through the library whole, so the ids are always those of the library's own call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Words' ids. Looking up a word that is not there takes it from ``old``, or puts it down in ``new`` and gives None until it is learned."""

    def __init__(self) -> None:
        self.old: dict[bytes, bytes] = {}
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.old.get(word)
        if ids is None:
            self.new.append(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes UTF-8 texts to ids as little-endian uint32 bytes; ``None`` counts as empty.

    Special-token strings in a text become special tokens, as the library has it by default. ``words`` bounds the
    words remembered, twice: when the young are that many they become the old, and the old of before are forgotten
    unless they were met again. ``folds`` says that the vocabulary's normaliser lower-cases, so words that differ in
    A-Z alone can be one; texts with combining marks are left as they are, since marks compose before letters are
    lower-cased. New words of lower-case letters that no normaliser changes skip the normaliser and the pattern.
    """

    MARK = b"\x01"  # a word of its own between new words; words that hold it are encoded alone
    END = "</w>"  # ends the last token of a run of letters
    TOGETHER = 2_500_000  # bytes of texts that are looked up before their new words are learned
    LETTERS = b"abcdefghijklmnopqrstuvwxyz"
    SMALL = re.compile(rb"(?:\xc3[\x9f-\xb6\xb8-\xbf])*")  # lower-case letters of U+00DF to U+00FF
    MARKS = ".,;:!?"

    def __init__(self, vocabulary: str, words: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._literals = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known, self._words = _Known(), words
        self._known[b""] = b""  # before white space at a text's start and behind that at its end
        mark = self._ids([self.MARK.decode()])[0]
        self._mark = mark[0] if len(mark) == 1 else None
        self._folds = self._ids(["QX"]) == self._ids(["qx"])
        vocab = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self._plain = Tokenizer.from_file(vocabulary)
        self._plain.normalizer = normalizers.Sequence([])
        self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        tried = ["straße", "q", "éàx", "thequick"]
        if self._plain.encode(" ".join(tried), add_special_tokens=False).ids != self._ids([" ".join(tried)])[0]:
            self._plain = None
        # marks that may follow a word of letters as a token of their own
        self._tails = {} if self._plain is None else {c.encode(): np.array(x[1:], "<u4").tobytes() for c in self.MARKS for x in self._ids(["q" + c]) if [x[:1], x[1:]] == self._ids(["q", c])}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: list[bytes]) -> None:
        for w, ids in zip(words, self._ids([w.decode("utf-8", "replace") for w in words]), strict=True):
            self._known[w] = np.array(ids, "<u4").tobytes()

    def _joined(self, words: list[bytes], between: bytes, ends, by) -> list[bytes]:
        """Encode many words as one text, parted where ``ends`` says; return those that did not part as they should."""
        failed = []
        parts = [words[i : i + 32] for i in range(0, len(words), 32)]
        for part, got in zip(parts, by.encode_batch_fast([between.join(p).decode("utf-8", "replace") for p in parts], add_special_tokens=False), strict=True):
            blob = np.array(got.ids, "<u4")
            stops, skip = ends(blob)
            if len(stops) != len(part):
                failed += part
                continue
            raw, start = blob.tobytes(), 0
            for w, end in zip(part, stops, strict=True):
                self._known[w] = raw[start:end]
                start = end + skip
        return failed

    def _letters_end(self, ids: np.ndarray) -> tuple[list[int], int]:
        return ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist(), 0

    def _mark_ends(self, ids: np.ndarray) -> tuple[list[int], int]:
        return [*(np.flatnonzero(ids == self._mark) * 4).tolist(), 4 * len(ids)], 4

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Learn words of lower-case letters, with or without a mark at their end; return the others."""
        known, small, tails = self._known, self.SMALL.fullmatch, self._tails
        letters, others, ended = [], [], []
        for w, rest in zip(words, b" ".join(words).translate(None, self.LETTERS).split(b" "), strict=True):
            if not rest or small(rest):
                letters.append(w)
            elif (tail := w[-1:]) in tails and len(w) > 1 and rest[-1:] == tail and small(rest, 0, len(rest) - 1):
                ended.append(w)
            else:
                others.append(w)
        fresh = {w[:-1] for w in ended}
        fresh = {w for w in fresh if known.get(w) is None}
        if known.old:
            for w in [w for w in fresh if w in known.old]:
                known[w] = known.old[w]
                fresh.discard(w)
        fresh.update(letters)
        failed = self._joined(list(fresh), b" ", self._letters_end, self._plain)
        if failed:
            self._alone(failed)
        for w in ended:
            known[w] = known[w[:-1]] + tails[w[-1:]]
        return others

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words many at a time. A word of letters alone ends with an ending token; between others goes the mark."""
        if self._plain:
            words = self._learn_plain(words)
        letters = [w for w in words if w.isalpha() or (w[0] >= 128 or w[-1] >= 128 or not w.isascii()) and w.decode("utf-8", "replace").isalpha()]
        rest = set(words).difference(letters)
        rest.update(self._joined(letters, b" ", self._letters_end, self._tokenizer))
        alone = list(rest) if self._mark is None else [w for w in rest if self.MARK in w]
        rest.difference_update(alone)
        self._alone(alone + self._joined(list(rest), b" \x01 ", self._mark_ends, self._tokenizer))

    def _folded(self, text: bytes) -> bytes:
        # combining marks are 0xCC and 0xCD and a byte more
        return text.lower() if self._folds and b"\xcc" not in text and b"\xcd" not in text else text

    def _looked_up(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, as an array of bytes; those not known are learned first."""
        known, asked = self._known, words.view(pa.large_binary()).to_pylist()
        ids = list(map(known.__getitem__, asked))
        if known.new:
            known.new, new = [], known.new
            self._learn(new)
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = known[asked[i]]
        return pa.array(ids, pa.large_binary())

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words: a mark behind a word of letters is taken off before the look-up and its token put behind the word's."""
        if not self._tails:
            return self._looked_up(words)
        marks = b"".join(self._tails).decode()
        ended = pc.match_substring_regex(words, f"^[a-z\u00df-\u00f6\u00f8-\u00ff]+[{marks}]$")
        roots = pc.if_else(ended, pc.utf8_rtrim(words, characters=marks), words).dictionary_encode()
        ids = self._looked_up(roots.dictionary).take(roots.indices)
        last = pc.if_else(ended, pc.utf8_slice_codeunits(words, -1), "")
        tails = pa.array([*self._tails.values(), b""], pa.large_binary()).take(pc.index_in(last, pa.array([*marks, ""], pa.large_string())))
        return pc.binary_join_element_wise(ids, tails, pa.scalar(b"", pa.large_binary()))

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids. Arrow parts the texts at ASCII white space, numbers their distinct words, and puts the words' ids
        in the order of the texts; only distinct words are looked up."""
        lists = pc.ascii_split_whitespace(pa.array(list(map(self._folded, texts)), pa.large_binary()).view(pa.large_string()))
        coded = lists.values.dictionary_encode()
        whole = self._ids_of(coded.dictionary).take(coded.indices)
        if not len(whole):
            return [b""] * len(texts)
        _, ends, data = whole.buffers()
        at = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
        held = memoryview(data)
        return [held[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode(self, texts: Sequence[bytes | None]) -> list[bytes]:
        out = [b""] * len(texts)
        some, at, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(x in t for x in self._literals):
                out[i] = np.array(self._ids([t.decode("utf-8", "replace")])[0], "<u4").tobytes()
                continue
            some.append(t)
            at.append(i)
            size += len(t)
            if size >= self.TOGETHER:
                self._put(out, some, at)
                some, at, size = [], [], 0
        if some:
            self._put(out, some, at)
        return out

    def _put(self, out: list[bytes], texts: list[bytes], at: list[int]) -> None:
        if len(self._known) > self._words:
            fresh = _Known()
            fresh.old, self._known = dict(self._known), fresh
            fresh[b""] = b""
        for i, ids in zip(at, self._together(texts), strict=True):
            out[i] = ids


_shared: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _shared:
        _shared[vocabulary] = WordEncoder(vocabulary)
    return _shared[vocabulary]
