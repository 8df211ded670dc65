"""Static graphs with labelled components: five CSV files, of which the background's may be very large.

``connected_components.csv`` (component, ccLabel), ``nodes.csv`` (node, component), ``edges.csv`` (two nodes of a component),
``background_nodes.csv`` and ``background_edges.csv`` (clId1, clId2 or the first two columns). Edges have no time and no amount: t is 0 and amount 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.stage import stage

FILES = ("connected_components.csv", "nodes.csv", "edges.csv", "background_nodes.csv", "background_edges.csv")
#: Fixed value: labels of components that are no rings.
LICIT = ("licit", "0", "0.0")


@dataclass(frozen=True)
class StaticGraph:
    edges: DataFrame  # src, dst, t, amount: the background's, or those with an end in a component
    rings: DataFrame  # ring, src, dst: edges of the components that aren't licit
    stats: DataFrame  # a row of counts


def missing_files(spark: SparkSession, folder: str) -> list[str]:
    """Which of the five files (or folders of parts) aren't there."""
    jvm = spark._jvm

    def there(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return [f for f in FILES if not there(f)]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _ends(df: DataFrame, first: str, second: str) -> DataFrame:
    names = [c if c in df.columns else df.columns[i] for i, c in enumerate((first, second))]
    return df.select(*[F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(names, ("src", "dst"), strict=True)])


def load(spark: SparkSession, folder: str, induced: bool = True) -> StaticGraph:
    """Read the five files. The background is scanned once; ``induced`` keeps edges with an end in a component, and the
    counts tell how many were scanned and kept, as observed in that scan.

    Missing files are named in a FileNotFoundError; an empty or unlabelled file is refused, as it would pass for a graph without rings.
    """
    if missing := missing_files(spark, folder):
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    parts, nodes, own = (_csv(spark, f"{folder}/{f}") for f in FILES[:3])
    if "ccLabel" not in parts.columns:
        raise ValueError("connected_components.csv lacks the column ccLabel")
    if len(nodes.columns) < 2:
        raise ValueError("nodes.csv needs a node and a component")
    for name, df in (("connected_components.csv", parts), ("nodes.csv", nodes)):
        if df.isEmpty():
            raise ValueError(f"{name} is empty")
    label = parts.select(F.col(f"`{parts.columns[0]}`").cast("string").alias("cc"), F.lower(F.trim("ccLabel")).alias("label")).groupBy("cc").agg(F.max("label").alias("label"))
    member = stage(nodes.select(F.col(f"`{nodes.columns[0]}`").cast("string").alias("node"), F.col(f"`{nodes.columns[1]}`").cast("string").alias("cc")).groupBy("node").agg(F.max("cc").alias("cc")))
    n_nodes = _csv(spark, f"{folder}/background_nodes.csv").count()
    if not n_nodes:
        raise ValueError("background_nodes.csv is empty")

    scan, kept = Observation("scanned"), Observation("kept")
    edges = _ends(_csv(spark, f"{folder}/background_edges.csv"), "clId1", "clId2").observe(scan, F.count(F.lit(1)).alias("n")).filter("src is not null and dst is not null")
    if induced:
        ends = member.select("node")
        flagged = edges.join(ends.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ends.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        edges = flagged.filter("_s or _d").select("src", "dst")
    edges = stage(edges.select("src", "dst", F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("amount")).observe(kept, F.count(F.lit(1)).alias("n")))

    cc = _ends(own, own.columns[0], own.columns[1]).join(member.toDF("src", "_a"), "src", "left").join(member.toDF("dst", "_b"), "dst", "left").withColumn("cc", F.coalesce("_a", "_b")).filter("cc is not null")
    labelled = stage(cc.join(label, "cc", "left").withColumn("licit", F.coalesce(F.col("label").isin(*LICIT), F.lit(False))).select("cc", "licit", "src", "dst"))
    rings = labelled.filter("not licit").select(F.col("cc").alias("ring"), "src", "dst")
    by = labelled.agg(F.count_distinct(F.when(F.col("licit"), F.col("cc"))).alias("n_licit"), F.count_distinct(F.when(~F.col("licit"), F.col("cc"))).alias("n_suspicious"))
    read, held = scan.get["n"], kept.get["n"]
    counts = [F.lit(v).cast("long").alias(k) for k, v in (("n_background_nodes", n_nodes), ("n_scanned", read), ("n_kept", held))]
    return StaticGraph(edges, rings, by.select(*counts, F.lit(held / read if read else 0.0).alias("kept_share"), "n_licit", "n_suspicious"))
