"""Stream compilation, pattern blocks at any split size, static graphs, and their refusals."""

import io
import random

import pytest

from loomgraph.sources import compile as K
from loomgraph.sources import patterns as N
from loomgraph.sources import static_graph as G

ROW = "2022/09/01 0{}:2{},00{},A{},0{},B{},{}.50,Euro,1.25,Yuan,Wire,1"


def made(seed, n=120):
    """Pattern text with every kind of fault, and what a plain walk over its lines makes of it."""
    r, out = random.Random(seed), []
    for _ in range(n):
        out.append(r.choice(["BEGIN LAUNDERING ATTEMPT - CYCLE: max 3 hops", "BEGIN LAUNDERING ATTEMPT - FAN-IN", "END LAUNDERING ATTEMPT - CYCLE", "END LAUNDERING ATTEMPT - FAN-IN", "", "  ", "BEGIN LAUNDERING ATTEMPT - lower", "short,row", ROW.format(1, 1, 1, 1, 1, 1, "x")] + [ROW.format(*(r.randint(0, 9) for _ in range(6)), r.randint(1, 9)) for _ in range(9)]))
    return out


def walk(lines):
    good, bad, kind, rows = [], {}, None, []

    def note(k):
        bad[k] = bad.get(k, 0) + 1

    def close():
        nonlocal kind, rows
        ok = [x for x in rows if x.count(",") == 10 and "x.50" not in x]
        for _ in range(len(rows) - len(ok)):
            note("malformed_row")
        if ok:
            good.append((kind, ok))
        else:
            note("empty_block")
        kind, rows = None, []

    for x in lines:
        if not x.strip():
            continue
        if x.startswith("BEGIN LAUNDERING ATTEMPT - ") and "lower" not in x:
            if kind:
                note("nested_begin")
                close()
            kind = x.split(" - ")[1].split(":")[0]
        elif x.startswith("END "):
            if kind is None:
                note("unmatched_end")
            else:
                if x.split(" - ")[1] != kind:
                    note("typology_mismatch")
                close()
        elif kind is None:
            note("orphan_row")
        else:
            rows.append(x)
    if kind:
        note("unclosed_at_eof")
        close()
    return good, bad


def parsed(text, split):
    rows = []
    for at in range(0, max(len(text), 1), split):
        rows += list(N.blocks(io.BytesIO(text), "f", at, min(at + split, len(text))))
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_blocks_are_alike_for_any_split(seed):
    end = "\r\n" if seed % 2 else "\n"
    lines = made(seed)
    text = end.join(lines).encode() + (b"" if seed % 3 else end.encode())
    whole = parsed(text, 1 << 20)
    for split in (1, 7, 64, 500, 3000):
        got = parsed(text, split)
        assert [x[1:4] for x in got if x[3] != "unclosed_at_eof" and x[3] != "empty_block"] == [x[1:4] for x in whole if x[3] != "unclosed_at_eof" and x[3] != "empty_block"]
        assert sorted(x[3] for x in got) == sorted(x[3] for x in whole)
    good, bad = walk(lines)
    found = {}
    for x in whole:
        if x[3] in N.ANOMALIES:
            found[x[3]] = found.get(x[3], 0) + 1
    assert found == bad
    blocks = {}
    for x in whole:
        if x[3] == "row":
            blocks.setdefault(x[1], []).append(",".join(x[6]))
    assert [b for _, b in sorted(blocks.items())] == [b for _, b in good]


@pytest.mark.parametrize("split", [100, 1 << 26])
def test_rings_are_numbered_in_order_and_strict_refuses(spark, tmp_path, split):
    lines = made(3, 300)
    (tmp_path / "a.txt").write_text("\n".join(lines))
    read = N.read_lines(spark, str(tmp_path / "a.txt"), split)
    good, bad = walk(lines)
    got = {}
    for r in N.rings(read).orderBy("ring", "place").collect():
        got.setdefault(r.ring, (r.typology, []))[1].append(r.amount)
    assert list(got) == list(range(len(good))) and [g[0] for g in got.values()] == [g[0] for g in good]
    assert [len(g[1]) for g in got.values()] == [len(g[1]) for g in good]
    assert {r.kind: r.n for r in N.anomalies(read).collect()} == bad
    with pytest.raises(ValueError, match="anomalies"):
        N.strict_rings(read)
    (tmp_path / "b.txt").write_text("BEGIN LAUNDERING ATTEMPT - CYCLE\n" + ROW.format(1, 2, 3, 4, 5, 6, 7) + "\nEND LAUNDERING ATTEMPT - CYCLE\n")
    clean = N.read_lines(spark, str(tmp_path / "b.txt"))
    first = N.strict_rings(clean).first()
    assert (first.src, first.dst, first.amount_key, first.currency, first.channel) == ("3:A4", "5:B6", "7.5", "Euro", "Wire")
    assert N.described(N.rings(clean)).first()[1:] == (1, 1, 2, 2, 2, 1, 1)


@pytest.mark.parametrize("parts", [1, 16])
def test_compiled_ids_are_dense_in_order_of_first_appearance(spark, tmp_path, parts):
    r = random.Random(4)
    rows = [(i, r.randint(0, 5000), f"a{min(int(r.expovariate(0.05)), 60)}", f"a{r.randint(0, 60)}", 1.0, r.choice(["x", "y", None]), 0, -1) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, t long, src string, dst string, amount double, channel string, label int, ring long").repartition(parts)
    table, nodes, counts = K.compile_stream(df, f"file://{tmp_path}/t{parts}")
    order = list(dict.fromkeys(k for x in rows for k in x[2:4]))
    ids = {k: i for i, k in enumerate(order)}
    assert {r.key: r.id for r in nodes.collect()} == ids
    assert sorted((x.seq, x.src, x.dst) for x in table.collect()) == [(x[0], ids[x[2]], ids[x[3]]) for x in rows if x[2] != x[3]]
    c = counts.first()
    assert (c.n_rows, c.n_self_loops, c.n_nodes) == (500, sum(x[2] == x[3] for x in rows), len(order))


def test_line_order_follows_the_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("".join(f"{k},{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        df = spark.read.schema("f int, i int").csv(str(tmp_path)).withColumn("o", K.line_order())
        assert [(r.f, r.i) for r in df.orderBy("o").collect()] == [(k, i) for k in range(3) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def static(tmp_path, **changed):
    files = {"connected_components.csv": "ccId,ccLabel\n1,suspicious\n2, Licit\n3,suspicious\n", "nodes.csv": "clId,ccId\na,1\nb,1\nc,2\nd,2\n", "edges.csv": "clId1,clId2\na,b\nc,d\nz,y\n", "background_nodes.csv": "clId,f1\na,1\nq,2\nr,3\n", "background_edges.csv": "txId,clId2,clId1\n1,a,q\n2,q,r\n3,b,a\n4,r,d\n5,,d\n"} | changed
    for name, text in files.items():
        if text is not None:
            (tmp_path / name).write_text(text)
    return f"file://{tmp_path}"


def test_static_graph_keeps_what_touches_a_component(spark, tmp_path):
    g = G.load(spark, static(tmp_path))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [("a", "b"), ("d", "r"), ("q", "a")]
    assert [tuple(r) for r in g.rings.collect()] == [("1", "a", "b")]
    assert tuple(g.stats.first()) == (3, 5, 3, 0.6, 1, 1)
    assert G.load(spark, f"file://{tmp_path}", induced=False).edges.count() == 4


def test_static_graph_refusals(spark, tmp_path):
    path = static(tmp_path, **{"edges.csv": None, "nodes.csv": None})
    assert G.missing_files(spark, path) == ["nodes.csv", "edges.csv"]
    with pytest.raises(FileNotFoundError, match="nodes.csv, edges.csv"):
        G.load(spark, path)
    with pytest.raises(ValueError, match="ccLabel"):
        G.load(spark, static(tmp_path, **{"connected_components.csv": "a,b\n1,2\n"}))
    with pytest.raises(ValueError, match="background_nodes.csv is empty"):
        G.load(spark, static(tmp_path, **{"background_nodes.csv": "clId,f1\n"}))


def test_bad_transactions_are_kept_apart(spark, tmp_path):
    from loomgraph.sources import readers

    good = "2022/09/01 00:20,010,A,3,B,1.50,Euro,1.50,Euro,Wire,0"
    (tmp_path / "t.csv").write_text("\n".join(["h" + ",h" * 10, good, "too,short", good + ",long", good]) + "\n")
    assert readers.transactions(spark, str(tmp_path / "t.csv")).count() == 2
    assert sorted(r.line for r in readers.bad_transactions(spark, str(tmp_path / "t.csv")).collect()) == [good + ",long", "too,short"]


@pytest.mark.parametrize("most", [1000, 120, 10])
def test_fixture_slice_keeps_rings_and_thins_evenly(spark, most):
    r = random.Random(8)
    rows = [(i, r.randint(0, 999), r.randint(0, 40), r.randint(41, 80), 1.0, 3 if i % 40 == 0 else -1) for i in range(400)]
    df = lambda parts: spark.createDataFrame(rows, "seq long, t long, src long, dst long, amount double, ring long").repartition(parts)
    got = [tuple(sorted(map(tuple, K.fixture_slice(df(p), 100, 900, most)[0].collect()))) for p in (1, 7)]
    assert got[0] == got[1]
    inside = [x for x in rows if 100 <= x[1] < 900]
    labelled = [x for x in inside if x[5] >= 0]
    assert {x[0] for x in got[0]} >= {x[0] for x in labelled} and len(got[0]) <= max(most, len(labelled))
    ids = {x for row in got[0] for x in row[2:4]}
    assert ids == set(range(len(ids)))
