"""The conversation trie against a plain version, with parts split at every limit."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, up string, b long, turns string"


def made(seed=3):
    r, rows = random.Random(seed), []
    say = [None, "", "hello", "été", "日本", "a b c", "x" * 50, "why?"]
    for c in [*range(0, 60), *range(100, 190), *range(301, 330), -7, -205, 5000]:
        rows += [(c, t, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", say[r.randint(0, 3 if t < 3 else 7)]) for t in range(r.randint(1, 7))]
    for c in range(400, 480):  # one conversation holds many others' start, and many copies
        rows += [(c, t, "system", "the same") for t in range(4)] + ([(c, 9, "user", str(c))] if c % 4 == 0 else [])
    rows += [(600, t, "user", f"long {t}") for t in range(40)] + [(None, 1, "user", "nobody's"), (601, None, "user", "first"), (601, 0, "user", "second"), (602, 1, "a", "same"), (602, 1, "a", "same")]
    r.shuffle(rows)
    return rows


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * len(k[-1][1] if k else "")
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "u", 2, "t") for r in rows], SCHEMA)


@pytest.mark.parametrize("limit, parts", [(1000, 1), (1000, 7), (30, 3), (1, 5)])
def test_trie_equals_a_plain_version(spark, limit, parts):
    rows = made()
    got = P.report(table(spark, rows).repartition(parts), limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = made(8)
    assert sorted(map(tuple, P.shared_openings(table(spark, rows), 10).collect()), key=str) == plain(rows, False)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "one turn") for c in range(301, 340)]  # no conversation 300: the first h turns are lost
    got = sorted(map(tuple, P.report(table(spark, rows)).collect()), key=str)
    assert got == plain(rows) and got[0][1] == 0 or got[1][1] == 0


def test_empty_tables(spark):
    assert P.report(table(spark, [(None, 1, "a", "b")])).count() == 0
    assert P.report(table(spark, [(None, 1, "a", "b")]).limit(0)).count() == 0


def test_copies_of_one_conversation_are_joined_in_stretches(spark):
    rows = [(c, 0, "user", "copy") for c in range(0, 9000, 3)]
    got = P.distinct_paths(P.paths(table(spark, rows))).collect()
    assert len(got) == 1 and got[0].n == 3000 and got[0].ends == hashlib.sha256(",".join(map(str, range(0, 9000, 3))).encode()).hexdigest()
