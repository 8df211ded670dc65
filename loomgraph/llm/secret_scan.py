"""Secret scans: high-recall candidates, false findings removed by a random forest, by built-in functions alone.

Candidates are values given to a name like ``token``, ``key`` or ``password``, also in a query, passwords in URLs, keys in the
forms of known services, and runs of at least 20 token characters with a digit, with the dotted parts after them. The forest sees length, character transitions, coverage by dictionary words, path
marks and neighbouring words; it is trained on labelled findings that are made here in a fixed random order.

Null and empty texts have no secrets; repeated documents are each reported.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import spans, trees
from loomgraph.llm.common import wrapped

NAMES = r"(?i:(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwd|password|pwd|credential|(?<![A-Za-z])(?:key|auth|authorization|sig|signature|passphrase)(?![A-Za-z]))[A-Za-z0-9_-]{0,20}+)"
SCHEME = r"(?:(?i:bearer|basic|token)\s{1,3}+)?+"
GIVEN = NAMES + r"[\"']?\s{0,3}+[:=]\s{0,3}+[\"'`]?+" + SCHEME
NAMED = GIVEN + r"[^\s\"'`<>,;]{6,}+(?![\"']?\s{0,3}[:=])"
#: A query's parameter ends before the next one.
QUERY = r"[?&]" + NAMES + r"=[^\s\"'`<>,;&#]{6,}+"
LOGIN = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s:/@\"'`<>]*+:"
URL = LOGIN + r"[^\s/@\"'`<>]{3,}+(?=@)"
#: Forms that services give their keys; no digit is asked for.
KNOWN = r"(?<![A-Za-z0-9])(?:A(?:KI|SI)A[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|[rsp]k_(?:live|test)_[A-Za-z0-9]{10,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|glpat-[A-Za-z0-9_-]{16,}+|AIza[A-Za-z0-9_-]{30,}+)"
BLOB = r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+(?:\.[A-Za-z0-9+/_-]++)*+={0,2}"
CANDIDATE = f"{QUERY}|{URL}|{NAMED}|{KNOWN}|{BLOB}"
MASK = "[SECRET]"
#: Words that make a value look written by hand.
DICTIONARY = ("example", "sample", "dummy", "test", "demo", "change", "placeholder", "your", "here", "insert", "replace", "secret", "token", "password", "passwd", "key", "value", "string", "null", "none", "true", "false", "user", "admin", "root", "name", "file", "path", "home", "local", "config", "data", "http", "https", "www", "com", "index", "html", "page", "image", "static", "lib", "src", "usr", "node", "module", "package", "python", "java", "site", "version", "release", "build", "service", "server", "client", "request", "response", "function", "class", "object", "this", "that", "with", "from", "article", "news", "section", "chapter", "figure", "table")
KEYS, DULL = r"(?i)(?:key|secret|token|passw|pwd|credential|auth|bearer)\W*\w*\W*$", r"(?i)(?:commit|sha1?|md5|sum|hash|uuid|guid|id|rev|revision|checksum|etag|version|build|see|file|path)\W*$"


def value_of(hit: Column) -> Column:
    """The candidate without the name before it."""
    return F.regexp_replace(hit, f"^(?:[?&]?{GIVEN}|{LOGIN})", "")


def features(before: Column, hit: Column, after: Column) -> list[Column]:
    v = F.when(F.length(value_of(hit)) > 0, value_of(hit)).otherwise(hit)
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda p: (F.length(v) - F.length(F.regexp_replace(v, p, ""))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    turns = F.size(F.regexp_extract_all(v, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"), F.lit(0)))
    named = flag(hit.rlike(f"^(?:[?&]?{GIVEN}|{LOGIN})"))
    return [n.cast("double"), turns / n, share("(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[/]"), share("[_-]"), flag(v.rlike("^[0-9a-fA-F]+$")), F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(256)), share("(?i)[aeiou]"), named, flag(before.rlike(KEYS)), flag(before.rlike(DULL)), flag(before.rlike(r"[/\\.:]$|https?:\S*$")), flag(after.rlike(r"^[./\\]")), flag(v.rlike(r"^[$%{(\[<*.xX]|[(){}\[\]$%]|\.\.|^(.)\1+$"))]


def findings(n: int = 1200, seed: int = 23) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, hit, after, secret), ``n`` in all."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    hexa, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: pick(("an", "the", "ri", "lo", "en", "ste", "mo", "ka", "ver"), r.randint(1, 4))
    name = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "API_KEY", "TOKEN", "client_secret"[7:], "private-key"])
    gives = lambda: r.choice([" = ", "=", ": ", ' = "', '="', ': "', " = '"])
    known = lambda: r.choice(["ghp_" + pick(mixed, 36), "sk_live_" + pick(mixed, 24), "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), "xoxb-" + pick(mixed, 30), "glpat-" + pick(mixed, 20)])
    short = lambda: r.choice(["KEY", "AUTH", "key", "auth", "sig", "passphrase", "signature"])
    out = []
    for _ in range(n):
        text, tail = f"{word()} {word()} ", r.choice(['" ', "' ", " ", "\n", '"###', '"'])
        hx = pick(hexa, r.choice((32, 40, 40, 64)))
        cue, hit, y = r.choice([
            ("", name() + gives() + hx, 1), ("", name() + gives() + hx.upper(), 1), ("", name() + gives() + pick(mixed, r.randint(20, 48)), 1), ("", name() + gives() + pick(mixed, r.randint(20, 48)), 1),
            ("", name() + gives() + pick(mixed + "!#%&*+-", r.randint(10, 18)), 1), ("", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 12) + pick("0123456789", 4), 1), ("", "ghp_" + pick(mixed, 36), 1), ("Bearer ", pick(mixed, r.randint(30, 60)), 1), ("auth ", pick(mixed + "+/", 40) + "==", 1),
            ("", known(), 1), ("", r.choice([short(), name()]) + gives() + known(), 1), ("", short() + gives() + pick(mixed, r.randint(20, 48)), 1), ("", r.choice("?&") + short() + "=" + pick(mixed, r.randint(20, 48)), 1),
            (r.choice(["Bearer ", ""]), "eyJ" + pick(mixed, 33) + "." + pick(mixed + "_-", r.randint(20, 90)) + "." + pick(mixed + "_-", 43), 1), ("", "Authorization: Bearer " + "eyJ" + pick(mixed, 33) + "." + pick(mixed, r.randint(20, 90)) + "." + pick(mixed + "_-", 43), 1),
            ("", r.choice(["postgres", "https", "redis", "mysql", "amqp"]) + f"://{word()}:" + pick(mixed + r.choice(["", "!#%*+-"]), r.randint(8, 24)), 1),
            ("", short() + gives() + word() + word() + "ing", 0), ("", r.choice("?&") + short() + "=" + word() + word() + "er", 0), (r.choice(["https://", "www.", "https://example."]), f"{word()}/{word()}-{pick('0123456789', 4)}/{word()}-{word()}-{word()}.html", 0), ("", f"https://{word()}:password", 0),
            ("", name() + gives() + r.choice(["your_token_here", "changeme", "placeholder", "example_value", "insert-secret-here", "xxxxxxxxxx", "${TOKEN}", "$(password)", "************", "None_value", "test_password", "dummy-key-123"]), 0),
            ("", name() + gives() + word() + word(), 0), ("", name() + gives() + word() + "ing", 0), ("", name() + gives() + "get_" + word() + "(" + word(), 0),
            (r.choice(["commit ", "sha1: ", "md5 ", "checksum ", "etag "]), hx, 0), (r.choice(["id ", "uuid ", "guid: "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), 0),
            ("see /", "/".join(["usr", "lib", "python3", "site-packages", word(), word()]), 0), ("https://example.org/", f"news/article-{pick('0123456789', 5)}-{word()}-{word()}-{word()}", 0), ("file ", f"{word()}_{word()}_config_release_{pick('0123456789', 3)}", 0),
            ("", pick("0123456789", r.randint(20, 30)), 0), ("", word() + word() + word() + word() + word() + "tionthehere" + pick("0123456789", 1), 0), ("", f"{word()}-{word()}-{word()}-20{pick('0123456789', 2)}-{pick('0123456789', 2)}-{pick('0123456789', 2)}", 0),
        ])
        out.append((text + cue, hit, tail, y))
    return out


@lru_cache(maxsize=1)
def _model(_: int, precision: float) -> trees.Ensemble:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(findings(), "before string, hit string, after string, y int")
    got = np.array(rows.select(F.array(*features(*(F.col(c) for c in ("before", "hit", "after")))).alias("x"), "y").collect(), object)
    x, y = np.array(got[:, 0].tolist(), float), got[:, 1].astype(float)
    fit = np.arange(len(y)) % 3 > 0
    return trees.calibrated(trees.forest(x[fit], y[fit]), x[~fit], y[~fit], precision)


def judged(text: Column, model: trees.Ensemble) -> Column:
    """The candidates' matches with their value's length and whether it is a secret."""
    found = F.transform(spans.matches(text, CANDIDATE, "secret"), lambda m: F.struct(m.alias("m"), F.array(*features(m["before"], m["hit"], m["after"])).alias("x")))
    size = len(features(F.lit(""), F.lit(""), F.lit("")))

    def one(f: Column) -> Column:
        m, value = f["m"], value_of(f["m"]["hit"])
        own = F.when(F.length(value) > 0, F.length(value)).otherwise(F.length(m["hit"]))
        return F.struct(m["kind"].alias("kind"), m["n"].alias("n"), m["gap"].alias("gap"), m["hit"].alias("hit"), own.alias("size"), (model.column([F.get(f["x"], F.lit(i)) for i in range(size)]) >= model.threshold).alias("secret"))

    return F.transform(found, one)


def find(docs: DataFrame, precision: float = 0.97) -> DataFrame:
    """A row per candidate, and one without for a document that has none: _row, doc_id, start, end, secret."""
    model = _model(id(docs.sparkSession), precision)
    rows = spans.placed(docs.select("doc_id", "text"), judged(F.coalesce("text", F.lit("")), model))
    return rows.select(spans.ROW, "doc_id", (F.col("end") - F.col("_span.size")).alias("start"), "end", F.col("_span.secret").alias("secret"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, spans (start:end of the secrets' values, code points)."""
    one = F.when(F.col("secret"), F.struct("start", "end"))
    per = find(docs).groupBy(spans.ROW).agg(F.first("doc_id").alias("doc_id"), F.count("secret").alias("n_candidates"), F.count(one).alias("n_secrets"), F.array_sort(F.collect_list(one)).alias("a"))
    return per.select("doc_id", "n_candidates", "n_secrets", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


def redact(docs: DataFrame, precision: float = 0.97) -> DataFrame:
    """``docs`` with each secret's value replaced by MASK, and n_chars, where there is one, made right; no shuffle. Null texts stay null."""
    model = _model(id(docs.sparkSession), precision)
    text = F.col("text")
    parts = F.split(text, CANDIDATE, -1)
    shown = F.transform("_secrets", lambda m, i: F.concat(F.get(parts, i), F.when(m["secret"], F.concat(F.left(m["hit"], F.length(m["hit"]) - m["size"]), F.lit(MASK))).otherwise(m["hit"])))
    whole = F.concat(F.array_join(shown, ""), F.element_at(parts, -1))
    out = wrapped(docs).withColumn("_secrets", judged(text, model)).withColumn("_new", F.when(F.exists("_secrets", lambda m: m["secret"]), whole).otherwise(text))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_new").isNull(), F.col("_all.n_chars")).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])
