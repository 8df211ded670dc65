"""Each corpus operator against a plain version on small tables with nulls, empty texts, repeats and odd columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from loomgraph.llm import components, decontaminate, html_text, language, packing, passages, pii, quality, records, secret_scan, simhash
from loomgraph.llm.common import flagged, has_flag
from loomgraph.llm.encoding import WordEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _words long, _secrets string"
R = random.Random(4)
VOCAB = ["".join(R.choice("abcdeiou") for _ in range(R.randint(1, 6))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, shared = prose(120), prose(300), prose(60)
    out = [a, a, b, b.replace(b.split()[7], "zzz", 1), f"{prose(40)} {shared} {prose(30)}", f"{prose(25)} {shared} {prose(80)}", prose(5), "", None, None, "Ünïcode 日本語 " + prose(9), "x " * 3000, "\t\n \x0b", prose(5200), 'key: token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "mail a.b@c-d.example.com, 10.0.0.255 and 300.1.1.1 +1 (017) 555-7713 4242 4242 4242 4242 x", "a@b.c_x@d.e 1.2.3.4.5.6.7.8 +12 1234-5678-9012-3456"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), 7, "s") for i, t in texts]
    return spark.createDataFrame(rows + [(None, "no id " + prose(30), None, None, 1, 1, "s"), rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def rows_of(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())  # untouched: special tokens as the library has them
    e = WordEncoder(default_vocabulary(), words=50)
    pool = ["a", "B", "İ", "ß", "é", "É", "ª", "J̌", "'s", "1", "２", "Ω", "中", "…", "--", "\x01", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\u00a0", "\u3000", "\n", "Σ", "\u0301x", "'LL", ".", ",", "a.", "é,", "µ", "K"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|ENDOFTEXT|>y", "word. word, word.. (word), Word; straße: naïve!"]
    texts += ["".join(R.choice(pool) for _ in range(R.randint(0, 25))) for _ in range(1500)]
    for k in range(0, len(texts), 20):
        part = texts[k : k + 20]
        assert e.encode([t.encode() for t in part]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part], part


def test_token_files(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/r"
    index = records.write_token_files(docs, path)
    got = [tuple(r) for r in records.read_token_files(index, path).orderBy("start").collect()]
    start, expected = 0, []
    for i, t in rows_of(docs):
        x = ids(t)
        expected.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == expected
    some = records.read_records(index.filter("doc_id in (2, 13)").orderBy(index.doc_id.desc()), path).collect()
    assert {r.doc_id: r.ids for r in some} == {i: ids(t).tolist() for i, t in rows_of(docs) if i in (2, 13)}
    assert records.token_files(empty).count() == 0


def test_damaged_records_are_refused():
    import pyarrow as pa

    good = records.frame(b"abc") + records.frame(b"")
    assert list(records.unframe(pa.BufferReader(good))) == [b"abc", b""]
    for k in range(len(good)):
        with pytest.raises(ValueError):
            list(records.unframe(pa.BufferReader(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])))


def test_packing(spark, docs, empty):
    packed = packing.packed_documents(docs, capacity=512)
    got = packed.collect()
    expected = []
    for i, t in rows_of(docs):
        x = ids(t)
        expected += [(i, k, at, len(x[at : at + 512]), zlib.crc32(x[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(x), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    whole = sum(e[3] for e in expected)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.1 * whole / 512 + 1
    assert packing.packed_documents(empty).count() == 0


def test_packed_sequences_hold_their_pieces(spark, texts):
    own = spark.createDataFrame([(i, t) for i, t in texts if i in (0, 2, 7, 13)], "doc_id long, text string")
    packed = packing.packed_documents(own, capacity=512)
    rows = {s.sequence_id: s.ids for s in packing.sequences(packed, own, 512).collect()}
    whole = {i: ids(t).tolist() for i, t in texts}
    for r in packed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == whole[r.doc_id][r.start : r.start + r.length]


def test_alike_rows_are_packed_apart(spark):
    got = packing.pack(spark.createDataFrame([(None, 0, 7)] * 900, "doc_id long, piece int, length long"), 100, group=60).collect()
    fill = {}
    for g in got:
        fill[g.sequence_id] = fill.get(g.sequence_id, 0) + g.length
    assert len(got) == 900 and max(fill.values()) <= 100
    assert len({(s >> 24) & 0xFFFFFF for s in fill if s >> 58 == 0}) > 8  # groups of the first round


def test_packing_in_rounds(spark):
    r = random.Random(8)
    rows = [(i, 0, r.choice([5, 90, 300, 700, 1000])) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 1000, group=150).collect()
    assert sorted((g.doc_id, g.length) for g in got) == [(a, c) for a, _, c in rows]
    fill = {}
    for g in got:
        fill[g.sequence_id] = fill.get(g.sequence_id, 0) + g.length
    assert max(fill.values()) <= 1000
    assert len(fill) <= 1.06 * sum(c for *_, c in rows) / 1000


def test_sum_of_squares_places_by_the_smallest_sum():
    r = random.Random(2)
    lengths = np.array([r.randint(1, 20) for _ in range(300)])
    bins, offsets = packing.sum_of_squares(lengths, 20)
    fill = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        gaps = [20 - f for f in fill.values()]
        total = lambda g: sum(g.count(x) ** 2 for x in set(g) - {0})
        costs = {g: total([*[x for j, x in enumerate(gaps) if j != gaps.index(g)], g - s]) for g in set(gaps) if g >= s} | {20: total([*gaps, 20 - s])}
        mine = 20 - fill.get(b, 0)
        assert costs[mine] == min(costs.values()) and o == fill.get(b, 0)
        fill[b] = o + s


def test_quality_statistics(docs, empty, spark):
    for _, t in rows_of(docs) + [(0, "a b c d e f g h " * 4 + "q"), (0, "x y\nx y\n\n  \nz\nx y"), (0, "#a$ |é")]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        at, hit = {}, set()
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        for v in at.values():
            if len(v) > 1:
                hit.update(x for k in v for x in range(k, k + 8))
        assert quality.statistics(t.encode() if t is not None else None)[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit))
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert quality.report(empty, labels.limit(0)).count() == 0


def test_decision_list_is_learned():
    r = np.random.default_rng(1)
    x = {"a": r.random(900), "b": r.random(900)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = quality.learn(x, bad, np.arange(900) % 3 == 0)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= quality._covered(rule, x, 900)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_language(spark, empty):
    r = random.Random(5)
    word = {"aa": "abcdefg", "zz": "stuvwxyz"}
    rows = [(i, "".join(r.choice(word[k] + " ") for _ in range(200)), k) for i in range(200) for k in [r.choice(["aa", "zz"])]] + [(900, None, "aa"), (901, "123 --", "zz"), (902, "abc", None), (None, "tuv", None)]
    got = language.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    for g in got:
        if g.doc_id is not None:
            assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
        if g.doc_id in (900, 901):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        elif truth[g.doc_id]:
            assert g.lang_pred == truth[g.doc_id] and 0.5 < g.score <= 1
    assert language.report(empty).count() == 0


def test_decontamination(spark, docs, empty):
    base = {i: t for i, t in rows_of(docs)}
    items = [("a", " ".join(base[2].split()[50:75])), ("b", "日本語"), ("c", ""), ("d", None), (None, base[0]), ("e", prose(12)), ("a2", " ".join(base[2].split()[55:66]).upper())]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, _n_hit int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    expected = []
    for i, t in rows_of(docs):
        w, hit, found, longest = words(t), set(), set(), 0
        for item, text in items:
            v = words(text)
            m = min(10, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[k : k + m]:
                        hit.update(range(p, p + m))
                        found.add(item)
                        n = m
                        while w[p + n : p + n + 1] == v[k + n : k + n + 1] != []:
                            n += 1
                        longest = max(longest, n)
        found.discard(None)
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest))
    rows = decontaminate.report(docs, bench).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(expected, key=str)
    for r in rows:
        if r.longest_match and r.match_item:
            v, w = words(dict(items)[r.match_item]), words(base[r.doc_id])
            assert v[r.match_item_at : r.match_item_at + r.longest_match] == w[r.match_at : r.match_at + r.longest_match]
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not e[5] for e in expected)
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_simhash_groups(spark, docs, empty):
    from xxhash import xxh64_intdigest

    prints = {}
    for i, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        prints.setdefault(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), []).append(i)
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, f"{p:016x}") for p, v in prints.items() for i in v}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (0, 1)").count() == 1 and kept.filter("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_lose_no_link(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    values = set(base) | {0}
    for b in base:
        for _ in range(12):
            for k in r.sample(range(64), r.randint(1, 6)):
                b ^= 1 << k
            values.add(b)
    values = sorted(values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, signed(v)) for i, v in enumerate(values)]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, _fingerprint long")).collect()}
    first = {v: i for i, v in enumerate(values)}
    assert got == {i: first[find(v)] for i, v in enumerate(values)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} or got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_passages(spark, docs, empty):
    got = {r.doc_id: r for r in passages.report(docs).collect()}
    assert {0, 1, 2, 3, 4, 5} == set(got)
    assert got[1].class_id == 0 and got[3].class_id == 2 and got[5].class_id == 4
    start, end = map(int, got[4].spans.split(":"))
    assert start <= 40 and end >= 100 and end - start <= 70
    assert passages.report(empty).count() == 0
    out = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert out[0] and out[1] == "" and len(out[5].split()) < 120


def test_compact_windows_hold_every_subsequence_once():
    r = np.random.default_rng(3)
    for n, top in ((30, 1 << 40), (40, 6)):
        x = r.integers(0, top, n).astype(np.uint64)
        found = passages.compact_windows(x, 5)
        for i in range(n):
            for j in range(i + 4, n):
                low = int(x[i : j + 1].min())
                assert any(a <= i and j <= b and int(x[c]) == low for a, c, b in found)


def test_pii(spark, docs, empty):
    luhn = lambda s: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0
    checks = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h, d: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h, d: all(int(x) <= 255 for x in h.split("."))), "card": (r"[0-9]([\x20-]?[0-9])+", lambda h, d: 16 <= len(d) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h, d: 8 <= len(d) <= 15)}
    expected = []
    for i, t in rows_of(docs):
        found = [(k, m.start(), m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
        expected.append((i, *[sum(f[0] == k for f in found) for k in checks], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in pii.report(docs).collect()), key=str) == sorted(expected, key=str)
    extra = spark.createDataFrame([(1, "please call (212) 555-0187 today"), (2, "order 123456789 of 12/05/2021")], "doc_id long, text string")
    added = {r.doc_id: r.spans for r in pii.report(extra).collect()}
    assert added == {1: "number:12:26", 2: ""}
    assert pii.report(empty).count() == 0


def test_secrets(spark, docs, empty):
    got = {r.doc_id: r for r in secret_scan.report(docs).collect()}
    assert got[14].spans == "14:54" and got[14].n_secrets == 1 and got[0].n_secrets == 0
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert text[14] == ('key: token = "[SECRET]" end', 27) and text[8] == (None, None) and text[2][0] == dict(rows_of(docs))[2]
    placeholders = spark.createDataFrame([(1, 'token = "your_token_here"'), (2, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed"), (3, "see /usr/lib/python3/site-packages/thing")], "doc_id long, text string")
    assert secret_scan.report(placeholders).filter("n_secrets > 0").count() == 0
    assert secret_scan.report(empty).count() == 0


def test_extraction(spark):
    trained, r, hit, miss, extra = html_text.model(), random.Random(77), 0, 0, 0
    for _ in range(150):
        page, inside = html_text.sample_page(r)
        inside = inside & {w.strip(".") for w in re.findall(r"w\d+", page)}
        got = {w.strip(".") for w in html_text.main_text([page], trained)[0].split()}
        hit, miss, extra = hit + len(got & inside), miss + len(inside - got), extra + len(got - inside)
    assert hit / (hit + miss) > 0.98 and hit / (hit + extra) > 0.98
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<body><nav><ul><li><a href=/>x</a></ul></nav><article><h1>A &amp;  B</h1><p><b>one<br>two<p>three &eacute;<div class='ad'>buy it now</div></article><footer>&copy; me</footer>")], "page_id long, url string, html string")
    got = {p.page_id: (p.text, p.n_chars) for p in html_text.extract(pages).collect()}
    assert got[1] == got[2] == ("", 0) and got[3][0].startswith("A & B\n\none two\n\nthree é") and "me" not in got[3][0]


def test_decoding_has_no_contradiction():
    nodes = html_text.parse("<div><div><p>a</p></div><p>b</p></div>")
    for seed in range(50):
        kept = html_text.decode(nodes, np.random.default_rng(seed).normal(size=len(nodes)))
        assert all(kept[n.up] for n, k in zip(nodes, kept, strict=True) if k)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, d).groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_passages_of_a_hot_line_meet_without_its_first_document(spark):
    r = random.Random(8)
    new = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    hot = new(40)
    rows, pairs = [(i, f"{new(60)} {hot} {new(60)}") for i in range(60)], []
    for k in range(60, 120, 2):
        tail = new(15)
        rows += [(k + j, f"{new(60)} {hot} {tail} {new(60)}") for j in (0, 1)]
        pairs.append((k, k + 1))
    got = {d.doc_id: d for d in passages.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {d for p in pairs for d in p}
    for a, b in pairs:
        assert got[a].class_id == got[b].class_id == a
        for d in (a, b):
            (start, end), *others = [tuple(map(int, s.split(":"))) for s in got[d].spans.split(",")]
            assert start <= 60 and end >= 115 and not others


def test_links_to_a_hot_document_are_dealt_out(spark, monkeypatch):
    r = random.Random(41)
    new = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    p = new(70)
    docs = spark.createDataFrame([(i, f"{new(i)} {p} {new(20)}") for i in range(40)], "doc_id long, text string").repartition(4)
    whole = sorted(map(tuple, passages.report(docs).collect()))
    monkeypatch.setattr(passages, "HOT", 3)
    assert sorted(map(tuple, passages.report(docs).collect())) == whole and len(whole) == 40


def test_every_place_of_a_passage_counts(spark):
    r = random.Random(9)
    new = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    p, q, s = new(60), new(60), new(60)
    texts = [f"{p} {new(70)} {p} {new(70)} {p}", p, q, f"{q} {new(70)} {q}", f"{s} {s} {s}", s, s, f"{s} {s}", f"{new(300)}"]
    got = {d.doc_id: d for d in passages.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = {k: [tuple(map(int, x.split(":"))) for x in d.spans.split(",")] for k, d in got.items()}
    inside = {k: {i for a, b in v for i in range(a, b)} for k, v in spans.items()}
    for k, starts in {0: (0, 130, 260), 1: (0,), 2: (0,), 3: (0, 130), 4: (0, 60, 120), 5: (0,), 6: (0,), 7: (0, 60)}.items():
        assert all(i in inside[k] for a in starts for i in range(a, a + 60)), (k, spans[k])
    assert set(got) == set(range(8)) and len(spans[0]) == 3 and len(spans[3]) == 2


def test_windows_stand_at_each_equal_minimum():
    x = np.array([5, 1, 6, 7, 8, 9, 1, 7, 6, 5, 4, 3, 1, 2, 9], np.uint64)
    found = passages.compact_windows(x, 5)
    assert {c for _, c, _ in found} >= {1, 6, 12}
    for i in range(len(x) - 4):
        c = i + int(x[i : i + 5].argmin())
        assert any(a <= i and i + 4 <= b and m == c for a, m, b in found)


def test_secret_forms(spark):
    r = random.Random(31)
    pick = lambda k, s="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(s) for _ in range(k))
    jwt = f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJ{pick(60)}.{pick(43)}"
    forms = [("GITHUB_AUTH=", "ghp_" + pick(36), " x"), ("STRIPE_KEY=", "sk_live_" + pick(24), " x"), ("auth=", pick(35), " x"), ("see https://h.org/f?a=1&sig=", pick(40), "&page=intro"), ("Authorization: Bearer ", jwt, " x"), ("Bearer ", jwt, " x"), ("aws ", "AKIA" + pick(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " x"), ("at postgres://bob:", "Xk29fLq8vTz1mR", "@db.host/x")]
    rows = [(i, f"some words {a}{v}{b}") for i, (a, v, b) in enumerate(forms)]
    got = {x.doc_id: x.text for x in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"some words {a}{secret_scan.MASK}{b}" for i, (a, _, b) in enumerate(forms)}


def test_no_element_hides_the_rest_of_a_page():
    said = lambda page: "".join(sorted(s for n in html_text.parse(page) for _, s in n.pieces))
    for tag in ("svg", "math", "select", "xmp"):
        assert said(f"<div><p>a<{tag}>b</{tag}>c</p></div>d") == "abcd" and said(f"<div><p>a<{tag}>b</p></div>d") == "abd"
    assert said("<div>a<script>x</script>b<iframe>y</div>c") == "abc"


def test_place_among_siblings_at_any_size():
    column = len(html_text.TAGS) + 8
    for n in (63, 64, 200):
        x = html_text.features(html_text.parse("<div>x</div>" * n))
        assert np.allclose(x[1:, column], np.arange(n) / n)


def near_copies(seed, families=60):
    """Documents, and the pairs of them that a passage of changed copies joins, by the operator's own proof on all diagonals."""
    r = random.Random(seed)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows, members, hot = [], [], new(30)
    for f in range(families):
        base = new(90)
        for _ in range(6):
            own = list(base)
            for at in r.sample(range(90), r.randint(0, 2)):
                own[at] = new(1)[0]
            members.append((len(rows), f, own))
            rows.append((len(rows), " ".join(new(r.randint(0, 80)) + own + (hot if f % 3 == 0 else new(9)) + new(r.randint(0, 80)))))
    least, pairs = passages.WORDS - passages.SHINGLE + 1, []
    for i, f, a in members:
        for j, g, b in members[:i]:
            if f == g:
                x, y = (passages.shingles(" ".join(w).encode()).astype(np.uint32) for w in (a, b))
                if passages.agreeing(x, y, 0, least):
                    pairs.append((i, j))
    return rows, pairs


def test_near_copies_share_a_class_whatever_the_partitions(spark):
    rows, pairs = near_copies(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts in (1, 16):
        got = {d.doc_id: d for d in passages.report(docs.repartition(parts, "doc_id")).collect()}
        assert all(i in got and j in got and got[i].class_id == got[j].class_id for i, j in pairs)
        results.append({k: (d.class_id, d.class_size) for k, d in got.items()})
    assert len(pairs) > 600 and results[0] == results[1]


def window_pairs(rows):
    """All pairs of windows of a key in two documents that prove a passage: (doc, to_doc, first word, last word) on the side of ``doc``."""
    least = passages.WORDS - passages.SHINGLE + 1
    base = {d: passages.shingles(t.encode()) for d, t in rows}
    x32 = {d: b.astype(np.uint32) for d, b in base.items()}
    by, found = {}, set()
    for d, b in base.items():
        key, _, place, _ = passages._windows_of([(d, b)], least, passages.HASHES)
        for k, p in zip(key.tolist(), place.tolist()):
            by.setdefault(k, set()).add((d, p >> 24, p >> 8 & 255, p & 255))
    for group in by.values():
        for d, c, left, right in group:
            for e, f, to_left, to_right in group:
                if d != e:
                    a, b = c - min(left, to_left), c + min(right, to_right)
                    to = max(a - c + f - passages.SLACK, 0)
                    for s, t in passages.agreeing(x32[d][a : b + 1], x32[e][to : b - c + f + passages.SLACK + 1], c - f + to - a, least):
                        found.add((d, e, s + a, t + a + passages.SHINGLE))
    return found


def whole(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    got = {d.doc_id: d for d in passages.report(docs).collect()}
    pairs = window_pairs(rows)
    for d, e, s, t in pairs:
        assert d in got and e in got and got[d].class_id == got[e].class_id, (d, e)
        assert any(a <= s and t <= b for a, b in (map(int, x.split(":")) for x in got[d].spans.split(","))), (d, s, t, got[d].spans)
    return got, pairs


def test_changed_passages_behind_a_hot_line_all_meet(spark):
    r = random.Random(51)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    hot, rows = new(40), []
    for _ in range(40):
        rows.append(new(60) + hot + new(60))
    for _ in range(40):
        tail = new(16)
        for j in (0, 1):
            own = [*hot, *tail]
            own[20 + j] = new(1)[0] if r.random() < 0.2 else own[20 + j]
            own[46] = new(1)[0]
            rows.append(new(60) + own + new(60))
    _, pairs = whole(spark, [(i, " ".join(x)) for i, x in enumerate(rows)])
    assert len({p[:2] for p in pairs}) >= 40


def test_drifting_copies_all_meet(spark):
    r = random.Random(52)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(8):
        own = new(70)
        for _ in range(14):
            own = list(own)
            own[r.randrange(70)] = new(1)[0]
            rows.append(new(r.randint(0, 60)) + own + new(r.randint(0, 60)))
    r.shuffle(rows)
    _, pairs = whole(spark, [(i, " ".join(x)) for i, x in enumerate(rows)])
    assert len({p[:2] for p in pairs}) > 200


def test_changed_passages_in_lists_meet(spark):
    r = random.Random(53)
    new = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    line, rows = new(25), []
    for _ in range(6):
        entry = new(30)
        for _ in range(2):
            own = [w for _ in range(20) for w in [*new(30), *line]] + entry
            own[-12] = new(1)[0]
            rows.append(own + new(30))
    _, pairs = whole(spark, [(i, " ".join(x)) for i, x in enumerate(rows)])
    assert len({p[:2] for p in pairs}) >= 8


def test_passages_leave_other_columns_and_white_space_alone(spark):
    r = random.Random(2)
    new = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    p, lead, tail = new(60), new(12).replace(" ", "\n\t"), new(12).replace(" ", "  ")
    docs = spark.createDataFrame([(1, f"a\n\n{p}\tb  c", "x", "k", 1), (2, f" {lead}\n {p}\n\n{tail}\n", "y", "l", 2), (3, None, "z", "m", 3), (2, "", "w", "n", 4)], "doc_id long, text string, _doc string, _spans string, doc long")
    out = passages.without_repeats(docs)
    assert out.columns == docs.columns
    got = {tuple(x)[2]: tuple(x) for x in out.collect()}
    # a passage may hold up to five words beside the equal ones at either end
    left = got["y"][1]
    assert left.startswith(" " + "\n\t".join(lead.split()[:7])) and left.endswith("  ".join(tail.split()[5:]) + "\n") and not set(p.split()) & set(left.split())
    assert got["y"][2:] == ("y", "l", 2) and got["x"][1] == docs.first().text and got["z"][1] is None and got["w"][1] == ""
    assert passages.report(docs).count() == 2


def test_suffix_search_equals_brute_force():
    r = random.Random(3)
    for trial in range(40):
        alphabet = [bytes([c]) for c in b"abcdefg"[: r.randint(1, 7)]]
        docs = [[r.choice(alphabet) for _ in range(r.randint(0, 40))] for _ in range(r.randint(1, 6))]
        items = [(str(k), b" ".join(r.choice([*alphabet, b"z"]) for _ in range(r.randint(0, 12)))) for k in range(5)]
        width = r.randint(1, 5)
        block = decontaminate.Block(items, width)
        code = {w: i + 1 for i, w in enumerate(sorted(set(block.words) - {b""}))}
        shard = decontaminate.Shard(docs, width, code, int(block.size.min()) if len(block.size) else width)
        flat = [code.get(w, 0) for d in docs for w in [*d, b""]]
        array = shard.array.tolist()
        padded = flat + [0] * width
        assert all(padded[a : a + width] <= padded[b : b + width] for a, b in zip(array, array[1:]))
        places, lengths, number, where, best, suffix = shard.matches(block)
        got = {(int(p), int(n), i) for p, n, w in zip(places, lengths, number) for i in shard.same[int(w)]}
        expected, longest = set(), {}
        texts = [[code[w] for w in t.split()] for _, t in items]
        for i, v in enumerate(texts):
            m = min(width, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                expected.update((p, m, i) for p in range(len(flat) - m + 1) if flat[p : p + m] == v[k : k + m])
        for p in {e[0] for e in expected}:
            longest[p] = max(next((n for n in range(min(len(v) - k, len(flat) - p), 0, -1) if flat[p : p + n] == v[k : k + n]), 0) for v in texts for k in range(len(v)))
        assert got == expected and dict(zip(where.tolist(), best.tolist())) == longest


def test_broken_markup_takes_time_in_proportion():
    import time

    for part, n in (("<p ", 350_000), ("<a x='", 170_000), ('<a x="', 170_000), ("<!--", 250_000), ("<script>", 120_000), ("</p", 300_000), ("<", 1_000_000), ("<svg>", 100_000), ("<a ''", 200_000)):
        for tail in ("", ">", "'>'", '">"'):
            start = time.process_time()
            html_text.parse(part * n + tail)
            assert time.process_time() - start < 20, part


def test_extraction_of_odd_tables(spark):
    schema = "page_id long, url string, html string, _text string"
    long = "<article>" + "".join(f"<p>w{i} and some more words of it</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (2, None, "<article><p>one two three four five six seven<select><option>x", None), (None, "v", "a < b > c &lt;", None)]
    got = [tuple(r) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 4 and got.count(got[0]) == 2 and got[0][3] == len(got[0][2]) and got[0][2].count("\n\n") == 19_999
    assert all("one two three" in g[2] for g in got if g[0] == 2)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_only_letters_make_a_language():
    for text in ("½ ² Ⅷ", "① ②", "12 -- _", "\u0301 \u0941", "", None):
        assert not len(language.grams(None if text is None else text.encode())[0]), text
    whole, parted = language.grams("हिन्दी".encode())[0], language.grams("ह न द".encode())[0]
    assert len(whole) > len(parted)


def test_tables_that_nothing_reads_any_more_are_deleted(spark, monkeypatch):
    texts = [f"{prose(5)} {s}" for s in [prose(70)] * 4 + [prose(80)] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    for name in ("stored", "bucketed"):
        monkeypatch.setattr(passages, name, lambda df, kind, *a, f=getattr(passages, name): (made.append((kind, out := f(df, kind, *a), out.inputFiles())), out)[1])
    assert passages.report(docs).count() == 7
    left = {kind for kind, _, files in made for f in files if os.path.exists(f.removeprefix("file://").removeprefix("file:"))}
    assert {"links", "diagonals", "runs", "met", "shared", "held", "probes", "pairs"} <= {kind for kind, _, _ in made}
    assert "parts" in left and left <= {"parts", "found", "classes", "passages", "hot"}


def test_flags_lose_no_row(spark):
    rows = [R.randrange(1 << 32) for _ in range(3000)]
    bits = flagged(spark.createDataFrame([(x,) for x in rows], "x long"), "x", 18).value
    assert has_flag(bits, np.array(rows, np.uint32)).all()
    assert int(np.unpackbits(bits).sum()) == len({x % (1 << 18) for x in rows})
    assert not flagged(spark.createDataFrame([], "x long"), "x", 16).value.any()


def test_flags_change_no_passage(spark, monkeypatch):
    hot, rows = prose(55), []
    for _ in range(6):
        own = prose(60).split()
        rows += [f"{hot} {' '.join(own)} {prose(9)}", f"{prose(7)} {hot} {' '.join(own[:30] + ['zz'] + own[31:])}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    whole = sorted(map(tuple, passages.report(docs).collect()))
    monkeypatch.setattr(passages, "has_flag", lambda bits, x: np.ones(len(x), bool))
    assert sorted(map(tuple, passages.report(docs).collect())) == whole and len(whole) == 12


def test_shingles_that_no_probe_asks_for_are_not_dealt_out(spark, monkeypatch):
    rows = near_copies(5, 6)[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, made, old = [], {}, (passages.flagged, passages.stored)
    monkeypatch.setattr(passages, "flagged", lambda df, *a: (asked.append(df.collect()), old[0](df, *a))[1])
    monkeypatch.setattr(passages, "stored", lambda df, kind: (out := old[1](df, kind), made.setdefault(kind, []).append(out.count()))[0])
    passages.report(docs).collect()
    assert len(asked) == 2 and len(asked[1]) == made["probes"][0] > 0 and made["pairs"][0] > 0  # of shared shingles, then of probes
    # with nothing asked for, nothing meets
    made.clear()
    monkeypatch.setattr(passages, "flagged", lambda df, column, size: old[0](df.limit(0) if "probes" in made else df, column, size))
    passages.report(docs).collect()
    assert made["probes"][0] > 0 and made["pairs"] == [0]


def test_proofs_equal_a_plain_version():
    r, least = random.Random(4), 12
    need, found = -(-8 * least // 9), 0
    for n in range(120):
        line = [r.randrange(30) for _ in range(r.randint(2, 40))]
        mine, other = ([x if r.random() > 0.06 else r.randrange(99) for x in (line * 60)[: r.randint(12, 320)]] for _ in range(2))
        other = other[r.randint(0, 9) :]
        starts = [s for s in range(len(mine) - least + 1) if n % 2 or r.random() < 0.8]
        hits = [(i, i - j) for i, x in enumerate(mine) for j, y in enumerate(other) if x == y]
        plain = set()
        for d in {d for _, d in hits}:
            band = {i for i, e in hits if d <= e <= d + 2 * passages.SLACK}
            plain |= {i for s in starts if sum(s + k in band for k in range(least)) >= need for i in range(s, s + least)}
        got = list(passages.proofs(np.array(mine, np.uint32), np.array(other, np.uint32), np.array(starts, np.int64), least))
        assert {i for a, b, _ in got for i in range(a, b + 1)} == plain
        found += len(plain) > 0
    assert found > 60


@pytest.mark.parametrize("page", ["<p><button>" + "<b>" * 80_000 + "<div></div>" * 70_000, "<div>" + "<b>" * 80_000 + "<li></li>" * 80_000, "<table>" * 30_000 + "<td>" * 30_000 + "<tr>" * 30_000, "<ul><li>" * 60_000])
def test_deep_nesting_does_not_cost_its_square(page):
    import time

    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 8


def test_raw_elements_end_at_their_end_tag_only():
    said = lambda page: "".join(s for n in html_text.parse(page) for _, s in n.pieces)
    assert said("<article>a<script src=/x/>var leaked=1;</script>b</article>") == "ab"
    assert said("<article>a<script src='x' />leaked</script>b<noscript>enable</noscript>c</article>") == "abc"
    assert said("<article>a<svg><title/>b</svg>c</article>") == "abc"
    assert said("<div><p>a<table><tr><td>b<p>c<div>d</div></td></tr></table>e</div>") == "eabcd"  # node by node: the outer one first
