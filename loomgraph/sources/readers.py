"""Readers of transactions, labelled patterns, accounts and append-only logs, and the domain's views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions import scalars as S
from loomgraph.sources import patterns as blocks
from loomgraph.sources.compile import line_order

TRANSACTIONS = "ts_text string, src_bank string, src_account string, dst_bank string, dst_account string, amount_received string, currency string, amount_paid string, currency_src string, channel string, label string"


def _transaction_lines(spark: SparkSession, path: str) -> DataFrame:
    read = F.length(F.concat_ws("", "ts_text", F.lit(" "))) > 0  # always true; a query of the bad lines' column alone, as a count may be, is refused
    return spark.read.schema(TRANSACTIONS + ", _bad string").option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).csv(path).filter(read)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """The eleven-column CSV; keys and types are made here. Lines of another width are left out, ``bad_transactions`` has them."""
    raw = _transaction_lines(spark, path).filter("_bad is null")
    return raw.select(F.to_timestamp("ts_text", "yyyy/MM/dd HH:mm").alias("ts"), S.account_key(F.col("src_bank"), F.col("src_account")).alias("src"), S.account_key(F.col("dst_bank"), F.col("dst_account")).alias("dst"), F.col("amount_received").cast("double").alias("amount"), S.amount_key(F.col("amount_received")).alias("amount_key"), "currency", "currency_src", "channel", F.col("label").cast("int").alias("label"))


def bad_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a transactions CSV that ``transactions`` leaves out: line."""
    return _transaction_lines(spark, path).filter("_bad is not null").select(F.col("_bad").alias("line"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Labelled edges of a BEGIN/END text: ring, typology, src, dst, ts, amount_key, currency."""
    return blocks.rings(blocks.read_lines(spark, path)).select("ring", "typology", "src", "dst", "ts", "amount_key", "currency")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a CSV; a key's first row in the files counts, blank ids don't."""
    raw = spark.read.schema("bank_name string, bank string, account string, entity_id string, entity_name string").option("header", True).csv(path).withColumn("line", line_order())
    keyed = raw.filter(F.trim("account") != "").withColumn("key", S.account_key(F.col("bank"), F.col("account")))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("bank_name", "entity_id", "entity_name"), "line").alias("r"))
    return first.select("key", S.country(F.col("r.bank_name")).alias("country"), "r.entity_id", S.entity_type(F.col("r.entity_name")).alias("entity_type"))


def events(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an append-only JSON log, each event once."""
    e = spark.read.json(path)
    return e.dropDuplicates(["event_id"]) if "event_id" in e.columns else e


def latest_events(spark: SparkSession, path: str, key: str, at: str) -> DataFrame:
    """The last event of each key of an append-only JSON log; of several at a time the one of the highest id."""
    e = events(spark, path)
    last = F.struct(at, *(["event_id"] if "event_id" in e.columns else []))
    return e.groupBy(key).agg(F.max_by(F.struct(*e.columns), last).alias("e")).select("e.*")


def label_edges(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """Labelled rows' ring by time, ends, amount and currency; the smallest ring of a key counts. ``rings`` is deduplicated, and broadcast only by Spark's own size check."""
    keys = ["ts", "src", "dst", "amount_key", "currency"]
    return edges.join(rings.groupBy(keys).agg(F.min("ring").alias("ring")), keys, "left").withColumn("ring", F.when(F.col("label") == 1, F.coalesce("ring", F.lit(-1))).otherwise(F.lit(-1)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (seq, src, dst, t minutes, amount, channel, label) of ``events``, without self-loops."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    dst = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    minutes = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - config.EPOCH_MINUTES).cast("long")
    label = ((F.col("event_type") == "error") & (F.col("value") > 60)).cast("int")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("src"), dst.alias("dst"), minutes.alias("t"), F.col("value").alias("amount"), F.col("event_type").alias("channel"), label.alias("label")).filter("src <> dst")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts (key, country, bank, entity_id, entity_type) of ``customer``, ``nation``."""
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("key"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("bank"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("entity_id"), F.col("c_mktsegment").alias("entity_type"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled edges with a ring number (made up from the table, for exercise)."""
    return edges(spark, sf_dir).filter("label = 1").withColumn("ring", F.pmod("src", F.lit(20)))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications (app_id, ts minutes, attribute, value) of ``orders``, one row per attribute."""
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    attrs = {"pan": F.col("o_custkey").cast("string"), "address": F.concat_ws("|", F.col("c_nationkey").cast("string"), day), "phone": F.floor(F.col("o_totalprice") / 10).cast("string")}
    return j.select(F.col("o_orderkey").alias("app_id"), F.explode(F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)])).alias("attribute", "value"))


def application_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the applications came: app_id, minutes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("app_id"), (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 1440).alias("minutes"))
