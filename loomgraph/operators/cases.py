"""Cases out of ranked candidates, their evidence, narrative, verdicts and what is learned from these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.resample import _draw, unit_sums

CONTROL = 0.10  # share of a queue drawn at random
POSITIVE = ("confirmed_ring", "confirmed_partial")
RATE, MOST_LIFT, MIN_ARM = 0.25, 5.0, 20


def numbered(df: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Sequential ids of five digits. Meant for queues, which are bounded by what analysts can read."""
    return df.withColumn("case_id", F.format_string(f"{prefix}-%05d", F.row_number().over(Window.orderBy(*order))))


def members(cand: DataFrame, inner: DataFrame) -> DataFrame:
    """A case's accounts with degrees by transaction and role, pass-through ones first: now, key, node, n_out, n_in, role, place."""
    d = inner.select("now", "seed", F.col("src").alias("node"), F.col("cnt").alias("o"), F.lit(0).cast("long").alias("i")).union(inner.select("now", "seed", "dst", F.lit(0).cast("long"), "cnt")).groupBy("now", "seed", "node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    m = cand.select("now", "seed", "key", F.explode("nodes").alias("node")).join(d, ["now", "seed", "node"], "left").na.fill(0, ["n_out", "n_in"])
    m = m.withColumn("role", S.role(F.col("n_in"), F.col("n_out")))
    first = Window.partitionBy("now", "key").orderBy((F.col("role") != "PASS_THROUGH").cast("int"), (-(F.col("n_in") + F.col("n_out"))), "node")
    return m.select("now", "key", "node", "n_out", "n_in", "role", F.row_number().over(first).alias("place"))


def ledger(cand: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Transactions between members within ``width`` minutes up to a case's opening, both ends included.

    Edges are met by sender and stretch of ``width`` minutes, of which a case touches two, so a busy account's whole history is not paired with all its cases.
    """
    m = cand.select("now", "key", F.explode("nodes").alias("node"))
    last = F.floor(F.col("now") / width)
    sent = m.withColumnRenamed("node", "src").withColumn("_stretch", F.explode(F.array(last - 1, last)))
    a = sent.join(edges.withColumn("_stretch", F.floor(F.col("t") / width)), ["src", "_stretch"]).filter((F.col("t") >= F.col("now") - width) & (F.col("t") <= F.col("now")))
    return a.join(m.withColumnRenamed("node", "dst"), ["now", "key", "dst"]).select("now", "key", "seq", "src", "dst", "t", "amount")


def narrative(member: DataFrame, book: DataFrame) -> DataFrame:
    """A cited text per case: now, key, text. Every sentence that states a figure ends in an id in brackets."""
    m = member.groupBy("now", "key").agg(F.count("*").alias("n"), F.sum((F.col("role") == "PASS_THROUGH").cast("int")).alias("mules"))
    t = book.groupBy("now", "key").agg(F.count("*").alias("txns"), F.sum("amount").alias("total"), F.min("seq").alias("first"))
    j = m.join(t, ["now", "key"], "left").na.fill(0, ["txns", "total"])
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    case = F.format_string("[CASE-%d]", F.col("now"))
    return j.select("now", "key", F.concat_ws(" ", say("The case covers ", F.col("n").cast("string"), " accounts ", case, "."), F.when(F.col("mules") > 0, say(F.col("mules").cast("string"), " of them pass value through ", case, ".")), F.when(F.col("txns") > 0, say("They exchanged ", F.col("txns").cast("string"), " payments of ", F.format_number("total", 2), " in all ", F.format_string("[TXN-%08d]", F.col("first")), ".")), F.lit("A person decides.")).alias("text"))


def uncited(texts: DataFrame, text: str = "text") -> DataFrame:
    """Sentences per row that state a figure without citing an id."""
    bare = F.filter(S.sentences(F.col(text)), lambda s: s.rlike("[0-9]") & ~s.rlike(r"\[[A-Z]+-[0-9]+\]"))
    return texts.withColumn("n_uncited", F.size(bare))


def verdicts_folded(events: DataFrame, key: str = "case_id") -> DataFrame:
    """The last verdict of each case by time, then event id."""
    return events.groupBy(key).agg(F.max_by("verdict", F.struct("at", "event_id")).alias("verdict"), F.count("*").alias("n_events"))


def term_evidence(cases: DataFrame) -> DataFrame:
    """Per term the two-by-two table of fired and confirmed, each case weighted by the inverse of its lane's chance; undecided cases stand aside.

    Rows are (case_id, lane, verdict, contrib map). Sums are taken before anything is shuffled.
    """
    decided = cases.filter(~F.col("verdict").isin("pending", "insufficient_evidence"))
    w = F.when(F.col("lane") == "control", 1 / CONTROL).otherwise(1.0)
    x = decided.select(w.alias("w"), F.col("verdict").isin(*POSITIVE).cast("double").alias("y"), F.explode("contrib").alias("term", "v")).withColumn("fired", F.col("v") > 0)
    on = lambda c: F.sum(F.when(F.col("fired"), c).otherwise(0.0))
    off = lambda c: F.sum(F.when(~F.col("fired"), c).otherwise(0.0))
    w, y = F.col("w"), F.col("w") * F.col("y")
    return x.groupBy("term").agg(on(w).alias("fired_n"), on(y).alias("fired_positive"), off(w).alias("not_fired_n"), off(y).alias("not_fired_positive"), F.sum(F.col("fired").cast("long")).alias("raw_fired"), F.sum((~F.col("fired")).cast("long")).alias("raw_not_fired"))


def term_rates(evidence: DataFrame) -> DataFrame:
    """Rates, lift (null where only the fired arm was ever confirmed, one where neither was) and prevalence."""
    rate = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(0.0)
    a, b = rate("fired_positive", "fired_n"), rate("not_fired_positive", "not_fired_n")
    lift = F.when(b > 0, a / b).when(a > 0, F.lit(None).cast("double")).otherwise(1.0)
    return evidence.select("*", a.alias("rate_fired"), b.alias("rate_not_fired"), lift.alias("lift"), (F.col("raw_fired") / (F.col("raw_fired") + F.col("raw_not_fired"))).alias("prevalence"))


def proposed_weights(rates: DataFrame, weights: DataFrame) -> DataFrame:
    """A quarter of the way from each weight to itself times its lift (five at most), where both arms have enough cases; then scaled to one."""
    j = weights.join(rates, "term", "left")
    enough = (F.coalesce("raw_fired", F.lit(0)) >= MIN_ARM) & (F.coalesce("raw_not_fired", F.lit(0)) >= MIN_ARM)
    target = F.col("weight") * F.least(F.coalesce("lift", F.lit(MOST_LIFT)), F.lit(MOST_LIFT))
    new = F.when(enough, F.col("weight") + RATE * (target - F.col("weight"))).otherwise(F.col("weight"))
    return j.select("term", "weight", new.alias("raw"), F.when(enough, "moved").otherwise("too_few_observations").alias("status")).withColumn("new_weight", F.col("raw") / F.sum("raw").over(Window.partitionBy())).drop("raw")


def lift_intervals(cases: DataFrame, groups: int = 200, resamples: int = 500, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Per term the lift and its percentile interval by resampling cases: term, lift, low, high.

    Cases are dealt at random into at most ``groups`` groups, which are what is drawn; so a resample costs the same for any number of cases. A lift over an arm that
    was never confirmed counts as ten, or as one if neither was.
    """
    decided = cases.filter(~F.col("verdict").isin("pending", "insufficient_evidence"))
    w = F.when(F.col("lane") == "control", 1 / CONTROL).otherwise(1.0)
    group = _draw(F.col("case_id"), F.lit(0), seed) % groups
    x = decided.select(group.alias("g"), w.alias("w"), F.col("verdict").isin(*POSITIVE).cast("double").alias("y"), F.explode("contrib").alias("term", "v"))
    cell = lambda c, fired: F.when(F.col("v") > 0 if fired else F.col("v") <= 0, c).otherwise(0.0)
    rows = x.select("g", "term", *[cell(c, f).alias(n) for n, c, f in (("fn", F.col("w"), True), ("fp", F.col("w") * F.col("y"), True), ("nn", F.col("w"), False), ("np", F.col("w") * F.col("y"), False))])
    sums = unit_sums(rows, "g", ["term"], ["fn", "fp", "nn", "np"], resamples, seed)
    rate = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(0.0)
    a, b = rate("fp", "fn"), rate("np", "nn")
    lift = sums.select("r", "term", F.when(b > 0, a / b).when(a > 0, 10.0).otherwise(1.0).alias("v"))
    v = F.sort_array(F.collect_list(F.when(F.col("r") >= 0, F.col("v"))))  # ``resamples`` numbers
    low, high = int((1 - level) / 2 * resamples + 1e-9), min(int((1 + level) / 2 * resamples + 1e-9), resamples - 1)
    return lift.groupBy("term").agg(F.max(F.when(F.col("r") < 0, F.col("v"))).alias("lift"), v[low].alias("low"), v[high].alias("high"))


def calibrated(rates: DataFrame, intervals: DataFrame, weights: DataFrame) -> DataFrame:
    """New weights with the reason for each term: term, weight, status, low, high, new_weight.

    A term moves only if both its arms have enough cases and the interval of its lift leaves out one: a quarter of the way to its weight times the lift (five at
    most), which stays within zero and one. All are scaled to a sum of one, to equal parts if that is zero.
    """
    j = weights.join(rates.select("term", "raw_fired", "raw_not_fired"), "term", "left").join(intervals, "term", "left")
    enough = (F.coalesce("raw_fired", F.lit(0)) >= MIN_ARM) & (F.coalesce("raw_not_fired", F.lit(0)) >= MIN_ARM)
    known = F.col("raw_fired").isNotNull()
    status = F.when(~known, "not_a_scored_term").when(~enough, "too_few_observations").when((F.col("low") <= 1) & (F.col("high") >= 1), "ci_includes_one").otherwise("moved")
    target = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * F.least("lift", F.lit(MOST_LIFT))))
    j = j.withColumn("status", status).withColumn("_new", F.when(F.col("status") == "moved", F.col("weight") + RATE * (target - F.col("weight"))).otherwise(F.col("weight")))
    total, n = F.sum("_new").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())  # a row per term
    gate = lambda c: F.when(F.col("status").isin("moved", "ci_includes_one"), F.col(c)).alias(c)
    return j.select("term", "weight", "status", gate("low"), gate("high"), F.when(total > 0, F.col("_new") / total).otherwise(1 / n).alias("new_weight"))


def training_rows(cases: DataFrame) -> DataFrame:
    """Resolved cases with their label and the features as they were stored (map ``features``): what the ranker learns from."""
    resolved = cases.filter(F.col("verdict") != "pending")
    return resolved.select("case_id", "lane", F.col("verdict").isin(*POSITIVE).cast("int").alias("label"), "verdict", F.transform_keys("features", lambda k, _: F.concat(F.lit("f_"), k)).alias("features"))


def console_stats(cases: DataFrame) -> DataFrame:
    """One row over cases (verdict, size, seconds): n, pending, labelled, accounts of confirmed ones per decision, and the median of seconds taken (of an even number the later)."""
    done = F.col("verdict") != "pending"
    took = F.when(done & (F.col("seconds") > 0), F.col("seconds"))
    accounts = F.sum(F.when(F.col("verdict").isin(*POSITIVE), F.col("size")).otherwise(0))
    n = F.count(F.when(done, 1))
    g = cases.agg(F.count("*").alias("n"), F.count(F.when(~done, 1)).alias("pending"), n.alias("labelled"), F.when(n > 0, F.round(accounts / n, 2)).otherwise(0.0).alias("accounts_per_decision"), (-F.percentile_approx(-took, 0.5, 1_000_000)).alias("median_seconds"))
    return g


OUTCOMES = ("llm_filed", "llm_rejected_uncited", "llm_rejected_unverifiable", "llm_unavailable")


def draft_ledger(events: DataFrame) -> DataFrame:
    """Counts of drafting outcomes, drafts attempted, rejected, and the share rejected, null without an attempt. An unknown outcome is refused."""
    n = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in OUTCOMES}
    known = events.withColumn("outcome", F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown drafting outcome: "), F.coalesce("outcome", F.lit("null"))))))
    g = known.agg(*[v.alias(o) for o, v in n.items()])
    rejected = F.col("llm_rejected_uncited") + F.col("llm_rejected_unverifiable")
    attempted = F.col("llm_filed") + rejected
    return g.select(*OUTCOMES, attempted.alias("attempted"), rejected.alias("rejected"), F.when(attempted > 0, rejected / attempted).alias("rejection_rate"))


def recommendations(events: DataFrame) -> DataFrame:
    """State of each recommendation out of its events (rec_id, at, event, evidence, rationale, by, approved): decided once, executed only if approved; what breaks a rule is refused and counted."""
    first = lambda name: F.min(F.when(F.col("event") == name, F.struct("at", "approved", "by")))
    good = events.filter((F.col("event") != "recommend") | ((F.size("evidence") > 0) & (F.trim("rationale") != "")))
    g = good.filter((F.col("event") != "decide") | (F.trim("by") != "")).groupBy("rec_id").agg(first("recommend").alias("r"), first("decide").alias("d"), F.max(F.when(F.col("event") == "execute", F.col("at"))).alias("x"))
    approved = F.coalesce(F.col("d.approved") & (F.col("d.at") >= F.col("r.at")), F.lit(False))
    status = F.when(F.col("d").isNull() | (F.col("d.at") < F.col("r.at")), "PENDING").when(approved, "APPROVED").otherwise("REJECTED")
    return g.filter("r is not null").select("rec_id", status.alias("status"), (approved & F.coalesce(F.col("x") >= F.col("d.at"), F.lit(False))).alias("executed"))
