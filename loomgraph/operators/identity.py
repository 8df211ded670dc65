"""Applications that share attribute values: links, candidates around an application and their features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.shapes import _distances, _links

RARE, HUB = 5, 50  # applications holding a value: up to the first rare, beyond the second a hub
ATTRIBUTES = ("pan", "phone", "address")


def linking(apps: DataFrame, most: int = RARE) -> DataFrame:
    """Rows (app_id, attribute, value, held) of values that two to ``most`` applications hold; ``held`` counts the whole population."""
    n = apps.groupBy("attribute", "value").agg(F.count("*").alias("held")).filter(F.col("held").between(2, most))
    return apps.select("app_id", "attribute", "value").join(n, ["attribute", "value"])


def around(apps: DataFrame, most: int = RARE) -> DataFrame:
    """Members (seed, app_id) of each linked application's candidate: itself and all that share a rare value with it."""
    few = linking(apps, most).select("app_id", "attribute", "value")
    return few.withColumnRenamed("app_id", "seed").join(few, ["attribute", "value"]).select("seed", "app_id").distinct()


def groups(member: DataFrame, apps: DataFrame) -> DataFrame:
    """Values that two members or more of a candidate hold: seed, attribute, value, size, members."""
    g = member.join(apps.select("app_id", "attribute", "value"), "app_id").groupBy("seed", "attribute", "value").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("app_id")).alias("members"))
    return g.filter("size >= 2")


def links(grouped: DataFrame) -> DataFrame:
    """Pairs of members and the attributes that link them: seed, u, v, attributes. Candidates are bounded, so their pairs are."""
    one = grouped.select("seed", "attribute", F.explode("members").alias("u"), "members").select("seed", "attribute", "u", F.explode("members").alias("v")).filter("u < v")
    return one.groupBy("seed", "u", "v").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))


def triangles(linked: DataFrame) -> DataFrame:
    """Triples u < v < w with both v and w linked to u: open and closed ones."""
    e = linked.select("seed", "u", "v")
    t = e.join(e.select("seed", "u", F.col("v").alias("w")), ["seed", "u"]).filter("v < w")
    c = t.join(e.select("seed", F.col("u").alias("v"), F.col("v").alias("w"), F.lit(1).alias("shut")), ["seed", "v", "w"], "left")
    return c.groupBy("seed").agg(F.count("shut").alias("closed"), (F.count("*") - F.count("shut")).alias("open"))


def features(member: DataFrame, apps: DataFrame) -> DataFrame:
    """Per candidate: size, links, density, shares of linking attributes, multiplicities, rotation, triangles, entropy."""
    g = groups(member, apps)
    linked = links(g)
    size = member.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    share = {a: F.sum(F.array_contains("attributes", a).cast("int")) for a in ATTRIBUTES}
    e = linked.groupBy("seed").agg(F.count("*").alias("n_edges"), *[v.alias(f"k_{a}") for a, v in share.items()])
    held = apps.groupBy("attribute", "value").agg(F.count("*").alias("held"))
    v = g.join(held, ["attribute", "value"]).groupBy("seed").agg(F.max("size").alias("max_multiplicity"), F.avg("size").alias("mean_multiplicity"), F.avg((F.col("held") <= RARE).cast("double")).alias("rare_share"), F.avg((F.col("held") > HUB).cast("double")).alias("hub_share"))
    j = size.join(e, "seed").join(v, "seed").join(triangles(linked), "seed", "left").na.fill(0)
    total = sum((F.col(f"k_{a}") for a in ATTRIBUTES), F.lit(0))
    p = lambda a: F.col(f"k_{a}") / total
    entropy = sum((F.when(F.col(f"k_{a}") > 0, -p(a) * F.log2(p(a))).otherwise(0.0) for a in ATTRIBUTES), F.lit(0.0))
    n, triples = F.col("n_nodes"), F.col("closed") + F.col("open")
    return j.select("seed", "n_nodes", "n_edges", (2 * F.col("n_edges") / (n * (n - 1))).alias("density"), (2 * F.col("n_edges") / n).alias("mean_degree"), *[(F.col(f"k_{a}") / F.col("n_edges")).alias(f"link_share_{a}") for a in ATTRIBUTES], "max_multiplicity", "mean_multiplicity", "rare_share", "hub_share", (1 - F.col("max_multiplicity") / n).alias("rotation_index"), F.when(triples > 0, F.col("open") / triples).otherwise(0.0).alias("open_triangle_ratio"), entropy.alias("link_type_entropy"))


#: Columns that measure how many a value may have by construction; kept in the record, not shown to a scorer.
EXCLUDED = ("max_pan_fanout", "max_phone_fanout", "max_device_fanout")
BURST_DAYS = 7


def connected(member: DataFrame, linked: DataFrame) -> DataFrame:
    """Components and diameter of each candidate: seed, n_components, largest_component, diameter, max_degree.

    A candidate's links travel as one array on its row; the bound on candidates bounds it. Members without a link are components of their own.
    """
    links_ = linked.groupBy("seed").agg(F.collect_list(F.struct("u", "v")).alias("e"))
    rows = member.groupBy("seed").agg(F.collect_list("app_id").alias("n")).join(links_, "seed", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seed, nodes, edges in zip(*(b.column(c).to_pylist() for c in ("seed", "n", "e")), strict=True):
                near = _links([(x["u"], x["v"]) for x in edges or ()])
                seen, sizes, far = set(), [], 0
                for n in nodes:
                    reach = _distances(n, near)
                    far = max(far, *reach.values())
                    if n not in seen:
                        seen |= reach.keys()
                        sizes.append(len(reach))
                out.append((seed, len(sizes), max(sizes), far, max((len(near.get(n, ())) for n in nodes), default=0)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["seed", "n_components", "largest_component", "diameter", "max_degree"])

    return rows.mapInArrow(run, "seed long, n_components long, largest_component long, diameter long, max_degree long")


def boundary(member: DataFrame, apps: DataFrame, most: int = RARE) -> DataFrame:
    """How many applications outside of a candidate share a rare value with a member: seed, n_external."""
    few = linking(apps, most).select("app_id", "attribute", "value")
    out = member.join(few, "app_id").join(few.withColumnRenamed("app_id", "other"), ["attribute", "value"]).select("seed", F.col("other").alias("app_id")).distinct()
    return out.join(member, ["seed", "app_id"], "left_anti").groupBy("seed").agg(F.count("*").alias("n_external"))


def fanouts(member: DataFrame, apps: DataFrame) -> DataFrame:
    """How many applications of the whole population hold the members' values: the most per attribute, and the mean."""
    held = apps.groupBy("attribute", "value").agg(F.count("*").alias("held"))
    j = member.join(apps.select("app_id", "attribute", "value"), "app_id").join(held, ["attribute", "value"])
    return j.groupBy("seed").agg(*[F.coalesce(F.max(F.when(F.col("attribute") == a, F.col("held"))), F.lit(0)).alias(f"max_{a}_fanout") for a in ATTRIBUTES], F.avg("held").alias("mean_fanout"))


def timing(member: DataFrame, times: DataFrame) -> DataFrame:
    """When a candidate's applications (times: app_id, minutes) came: span_days, mean_gap_days, max_gap_days, burst_index, the share in the busiest seven days."""
    own = Window.partitionBy("seed").orderBy("minutes")
    t = member.join(times, "app_id").withColumn("gap", F.col("minutes") - F.lag("minutes").over(own)).withColumn("near", F.count("*").over(own.rangeBetween(0, BURST_DAYS * 1440)))
    return t.groupBy("seed").agg(((F.max("minutes") - F.min("minutes")) / 1440).alias("span_days"), F.coalesce(F.avg("gap") / 1440, F.lit(0.0)).alias("mean_gap_days"), F.coalesce(F.max("gap") / 1440, F.lit(0.0)).alias("max_gap_days"), (F.max("near") / F.count("*")).alias("burst_index"))


def all_features(member: DataFrame, apps: DataFrame, times: DataFrame) -> DataFrame:
    """``features`` and what a candidate's connections, surroundings, values at large and timing add."""
    f = features(member, apps)
    linked = links(groups(member, apps))
    for part in (connected(member, linked), boundary(member, apps), fanouts(member, apps), timing(member, times), triangles(linked)):
        f = f.join(part, "seed", "left")
    n, triples = F.col("n_nodes"), F.coalesce(F.col("closed") + F.col("open"), F.lit(0))
    kinds = sum(((F.col(f"link_share_{a}") > 0).cast("int") for a in ATTRIBUTES), F.lit(0))
    return f.select(
        *[F.col(c) for c in f.columns if c not in ("largest_component", "n_external", "closed", "open")], (F.col("largest_component") / n).alias("largest_component_share"), (n / F.col("n_components")).alias("mean_component_size"), (F.coalesce("n_external", F.lit(0)) / n).alias("boundary_ratio"),
        kinds.alias("n_link_attributes"), (F.col("max_multiplicity") / n).alias("spanning_attribute_share"), F.when(triples > 0, F.col("closed") / triples).otherwise(0.0).alias("triangle_density"))


def ceilings(apps: DataFrame, labels: DataFrame) -> DataFrame:
    """Per attribute how many applications hold the most common value among good and among fraudulent ones (labels: app_id, fraud): attribute, legit_max, fraud_max, excluded.

    A ceiling that the makers of the data set on one side would be what a scorer learns, so such attributes are excluded.
    """
    held = apps.groupBy("attribute", "value").agg(F.count("*").alias("held"))
    j = apps.select("app_id", "attribute", "value").join(held, ["attribute", "value"]).join(labels, "app_id")
    most = lambda k: F.coalesce(F.max(F.when(F.col("fraud") == k, F.col("held"))), F.lit(0))
    g = j.groupBy("attribute").agg(most(0).alias("legit_max"), most(1).alias("fraud_max"))
    return g.withColumn("excluded", F.concat(F.lit("max_"), "attribute", F.lit("_fanout")).isin(*EXCLUDED))


def feature_names(rows: DataFrame) -> list[str]:
    """The columns a scorer may see, by name."""
    return sorted(c for c in rows.columns if c != "seed" and c not in EXCLUDED)


def action(rare: Column, attributes: Column) -> Column:
    """What to do about a candidate with so many rare shared values of so many attributes."""
    return F.when((rare >= 3) & (attributes >= 2), "REQUEST_STEP_UP_KYC").when(rare >= 1, "MANUAL_REVIEW").otherwise("MONITOR")


def recommended(grouped: DataFrame, apps: DataFrame) -> DataFrame:
    held = apps.groupBy("attribute", "value").agg(F.count("*").alias("held"))
    g = grouped.join(held, ["attribute", "value"]).withColumn("rare", F.col("held") <= RARE)
    n = g.groupBy("seed").agg(F.sum(F.col("rare").cast("int")).alias("n_rare"), F.count_distinct(F.when(F.col("rare"), F.col("attribute"))).alias("n_attributes"))
    return n.select("seed", "n_rare", action(F.col("n_rare"), F.col("n_attributes")).alias("action"))
