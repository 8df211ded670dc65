"""Personal data: exact base patterns, and further spans by boosted trees over high-recall candidates.

Base kinds (email, ip, card, phone) are patterns with a check each. Generators propose further, overlapping
spans: numbers in groups, spelled-out addresses, account numbers. Boosted trees see a candidate's format and
context; per-kind thresholds calibrated on examples kept back select what is added. An added span never
overlaps a base one, nor an earlier added one. The examples are made here, in a fixed random order.

Null and empty texts have no spans; repeated documents are each reported; more columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import spans, trees

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run of local characters is tried once, at its first character or right after a match: no later start in it can do better.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

NUMBER = r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,40}+(?![0-9A-Za-z])"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{2,40}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,40}+)++"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDED = {"number": NUMBER, "spelled_email": SPELLED, "account": ACCOUNT}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Of a string of digits: every second from the right doubled, nines cast out, sum divisible by ten."""
    each = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_holds(kind: Column, hit: Column) -> Column:
    n = F.length(digits(hit))
    part = F.transform(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small = F.forall(part, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(16, 19) & luhn(digits(hit))).when(kind == "phone", n.between(8, 15)).otherwise(False)


WORDS = {"call": r"(?i)(?:tel|phone|mobile|cell|call|fax|whatsapp|dial)[a-z]*\W*(?:\w+\W+)?$", "person": r"(?i)(?:ssn|social security|tax id|passport|licen[cs]e|insurance|born|birth)[a-z]*\W*(?:\w+\W+)?$", "money": r"(?i)(?:iban|account|acct|card|visa|bank)[a-z]*\W*(?:\w+\W+)?$", "mail": r"(?i)(?:mail|contact|write|reach|address)[a-z]*\W*(?:\w+\W+)?$", "other": r"(?i)(?:order|invoice|version|build|isbn|page|no|ref|id|ticket|lot|date|on|in|year|meet|meeting)\.?\W*$"}


def features(kind: Column, before: Column, hit: Column, after: Column) -> list[Column]:
    d = digits(hit)
    counted = lambda p: (F.length(hit) - F.length(F.regexp_replace(hit, p, ""))).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    form = [F.length(hit).cast("double"), F.length(d).cast("double"), counted("[ ]"), counted("[-]"), counted("[.]"), counted("[/]"), counted("[()]"), counted("[A-Z]"), counted("[a-z]"), flag(hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")), flag(hit.rlike(r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$")), flag(hit.rlike(r"^(?:19|20)[0-9]{2}|[/.-](?:19|20)[0-9]{2}$")), flag(hit.rlike(r"\(at\)|\[at\]")), flag(hit.rlike(r"dot|\.[a-z]{2,4}$"))]
    context = [flag(before.rlike(p)) for p in WORDS.values()] + [flag(after.rlike("^[%$€]")), flag(before.rlike(r"[$€#]\s?$"))]
    return [*[(kind == k).cast("double") for k in ADDED], *form, *context]


def examples(n: int = 900, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled candidates (kind, before, hit, after, personal), ``n`` in all."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "the", "ri", "lo", "en", "ste", "mo", "ka", "ver")) for _ in range(r.randint(1, 3)))
    out = []
    for _ in range(n):
        plain, tail = f"{word()} {word()} ", f" {word()} {word()}."
        s = r.choice("-. ")
        kind, cue, hit, y = r.choice([
            ("number", r.choice(["call ", "tel: ", "phone ", "mobile: ", "fax "]), f"({num(3)}) {num(3)}-{num(4)}", 1),
            ("number", r.choice(["call ", "tel. ", "phone: ", "cell "]), f"{num(3)}{s}{num(3)}{s}{num(4)}", 1),
            ("number", r.choice(["call ", "phone ", "mobile "]), "0" + num(r.randint(8, 10)), 1),
            ("number", r.choice(["SSN ", "social security ", "ssn: ", "tax id "]), f"{num(3)}-{num(2)}-{num(4)}", 1),
            ("number", r.choice(["order ", "invoice ", "ref ", "ticket ", "id ", "build "]), num(r.randint(7, 14)), 0),
            ("number", r.choice(["on ", "date ", "in ", ""]), f"{num(2)}/{num(2)}/20{num(2)}", 0),
            ("number", r.choice(["on ", "date ", ""]), f"20{num(2)}-{num(2)}-{num(2)}", 0),
            ("number", r.choice(["version ", "build ", ""]), f"{num(1)}.{num(2)}.{num(2)}.{num(3)}", 0),
            ("number", "", f"{num(r.randint(3, 5))} {num(r.randint(3, 5))} {num(r.randint(2, 4))}", 0),
            ("number", "", num(r.randint(7, 20)), 0), ("number", "isbn ", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", 0),
            ("spelled_email", r.choice(["mail ", "contact ", "write to ", ""]), f"{word()}.{word()} [at] {word()} [dot] com", 1),
            ("spelled_email", r.choice(["mail ", "reach ", "email: "]), f"{word()}{num(2)} at {word()} dot {r.choice(['com', 'org', 'net'])}", 1),
            ("spelled_email", r.choice(["mail ", ""]), f"{word()}(at){word()}.{r.choice(['com', 'org', 'de'])}", 1),
            ("spelled_email", r.choice(["meet ", "", "in "]), f"{word()} at {word()}.{word().capitalize()}", 0),
            ("spelled_email", r.choice(["", "look "]), f"{word()} at {word()}.{word().capitalize()}", 0),
            ("account", r.choice(["IBAN ", "account ", "iban: "]), f"{r.choice(['DE', 'FR', 'GB'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", 1),
            ("account", r.choice(["IBAN ", "bank ", ""]), f"{r.choice(['DE', 'ES', 'NL'])}{num(20)}", 1),
            ("account", r.choice(["lot ", "ref ", "id ", ""]), f"{r.choice(['AB', 'XK', 'QT'])}{num(2)}{''.join(r.choice('ABCDEFGHJK') for _ in range(8))}", 0),
        ])
        out.append((kind, plain + cue, hit, tail, y))
    return out


@lru_cache(maxsize=1)
def _model(_: int, precision: float) -> trees.Ensemble:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(examples(), "kind string, before string, hit string, after string, y int")
    got = np.array(rows.select(F.array(*features(*(F.col(c) for c in ("kind", "before", "hit", "after")))).alias("x"), "y").collect(), object)
    x, y = np.array(got[:, 0].tolist(), float), got[:, 1].astype(float)
    fit = np.arange(len(y)) % 3 > 0
    return trees.calibrated(trees.boost(x[fit], y[fit]), x[~fit], y[~fit], precision)


def find(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """A row per span, and one with a null kind for a document without: _row, doc_id, kind, start, end, base."""
    spark = docs.sparkSession
    model = _model(id(spark), precision)
    text = F.coalesce("text", F.lit(""))
    numeric = F.col("_digits")
    parts = [F.when(F.col("text").contains("@"), spans.matches(text, EMAIL, "email"))]
    parts += [F.when(numeric, spans.matches(text, p, k)) for k, p in (("ip", IP), ("card", CARD), ("phone", PHONE), ("number", NUMBER), ("account", ACCOUNT))]
    parts.append(F.when(F.col("text").rlike(r"(?<![A-Za-z])at(?![A-Za-z])"), spans.matches(text, SPELLED, "spelled_email")))
    none = F.filter(spans.matches(F.lit("x"), "y", "none"), lambda x: F.lit(False))
    found = F.concat(*[F.coalesce(p, none) for p in parts])
    rows = spans.placed(docs.select("doc_id", "text").withColumn("_digits", F.col("text").rlike("[0-9]")), found)
    kind, before, hit, after = (F.col(f"_span.{c}") for c in ("kind", "before", "hit", "after"))
    isbase = kind.isin(*BASE)
    rows = rows.withColumn("_x", F.when(~isbase, F.array(*features(kind, before, hit, after))))
    score = model.column([F.get("_x", F.lit(i)) for i in range(len(features(kind, before, hit, after)))])
    ok = F.when(isbase, base_holds(kind, hit)).otherwise((F.col("end") - F.col("start") > 0) & (score >= model.threshold))
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).select(spans.ROW, "doc_id", kind.alias("kind"), "start", "end", "_ok", (isbase & F.col("_ok")).alias("base"))
    order = Window.partitionBy(spans.ROW).orderBy("start", F.col("end").desc(), "kind")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    clear = (F.coalesce(F.max(F.when(F.col("_ok"), F.col("end"))).over(earlier), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.col("end")) >= F.col("end"))
    rows = rows.withColumn("_ok", F.col("_ok") & (F.coalesce("base", F.lit(False)) | clear))
    return rows.select(spans.ROW, "doc_id", F.when(F.col("_ok"), F.col("kind")).alias("kind"), "start", "end", F.coalesce("base", F.lit(False)).alias("base"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(BASE)], F.lit(len(BASE)))
    one = F.struct(rank.alias("r"), F.when(rank == len(BASE), F.col("kind")).alias("k"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"))
    per = find(docs).groupBy(spans.ROW).agg(F.first("doc_id").alias("doc_id"), *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("a"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    return per.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(F.filter("a", lambda x: x["r"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("a")).alias("spans"), F.size(F.filter("a", lambda x: x["r"] == len(BASE))).cast("long").alias("n_added"))
