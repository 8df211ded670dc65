"""Queries of identities, cases, verdicts, calibration and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import cases as K
from loomgraph.operators import identity as I
from loomgraph.operators.stage import stage
from loomgraph.plans.core import APPS, TO_CAND, _inner, ctes
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

IDENT = """few AS (SELECT attribute, value FROM apps GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5), fa AS (SELECT a.* FROM apps a JOIN few USING (attribute, value)), im AS (SELECT DISTINCT a.app_id AS seed, b.app_id FROM fa a JOIN fa b USING (attribute, value)),
 gr AS (SELECT seed, attribute, value, count(*) AS size FROM im JOIN apps USING (app_id) GROUP BY seed, attribute, value HAVING count(*) >= 2),
 il AS (SELECT x.seed, x.app_id AS u, y.app_id AS v, list_sort(list(DISTINCT a.attribute)) AS attributes FROM im x JOIN im y ON x.seed = y.seed AND x.app_id < y.app_id JOIN apps a ON a.app_id = x.app_id JOIN apps b ON b.app_id = y.app_id AND b.attribute = a.attribute AND b.value = a.value GROUP BY x.seed, x.app_id, y.app_id),
 held AS (SELECT attribute, value, count(*) AS held FROM apps GROUP BY ALL),
 tri AS (SELECT a.seed, count(c.u) AS closed, count(*) - count(c.u) AS open FROM il a JOIN il b ON a.seed = b.seed AND a.u = b.u AND a.v < b.v LEFT JOIN il c ON c.seed = a.seed AND c.u = a.v AND c.v = b.v GROUP BY a.seed)"""


def _identity(spark, d):
    apps = R.applications(spark, d)
    return stage(I.around(apps)), apps


@query("hp_internal_links", ctes(APPS, IDENT) + "SELECT seed, u, v, array_to_string(attributes, ',') AS attributes FROM il")
def _(spark, d):
    m, apps = _identity(spark, d)
    return I.links(I.groups(m, apps)).select("seed", "u", "v", F.array_join("attributes", ",").alias("attributes"))


@query("ft_triangles", ctes(APPS, IDENT) + "SELECT * FROM tri")
def _(spark, d):
    m, apps = _identity(spark, d)
    return I.triangles(I.links(I.groups(m, apps)))


@query("ft_identity", ctes(APPS, IDENT) + """, e AS (SELECT seed, count(*) AS n_edges, count(*) FILTER (list_contains(attributes, 'pan')) AS kp, count(*) FILTER (list_contains(attributes, 'phone')) AS kf, count(*) FILTER (list_contains(attributes, 'address')) AS ka FROM il GROUP BY seed),
 v AS (SELECT seed, max(size) AS mx, avg(size) AS av, avg(CASE WHEN held <= 5 THEN 1.0 ELSE 0 END) AS rare, avg(CASE WHEN held > 50 THEN 1.0 ELSE 0 END) AS hub FROM gr JOIN held USING (attribute, value) GROUP BY seed)
 SELECT seed, n AS n_nodes, n_edges, round(2.0 * n_edges / (n * (n - 1)), 6) AS density, round(2.0 * n_edges / n, 6) AS mean_degree, round(kp * 1.0 / n_edges, 6) AS link_share_pan, round(kf * 1.0 / n_edges, 6) AS link_share_phone, round(ka * 1.0 / n_edges, 6) AS link_share_address, mx AS max_multiplicity, round(av, 6) AS mean_multiplicity, round(rare, 6) AS rare_share, round(hub, 6) AS hub_share, round(1 - mx * 1.0 / n, 6) AS rotation_index,
 round(coalesce(open * 1.0 / nullif(open + closed, 0), 0), 6) AS open_triangle_ratio, round(-(coalesce(kp * log2(nullif(kp, 0) * 1.0 / (kp + kf + ka)), 0) + coalesce(kf * log2(nullif(kf, 0) * 1.0 / (kp + kf + ka)), 0) + coalesce(ka * log2(nullif(ka, 0) * 1.0 / (kp + kf + ka)), 0)) / (kp + kf + ka), 6) + 0.0 AS link_type_entropy
 FROM (SELECT seed, count(*) AS n FROM im GROUP BY seed) JOIN e USING (seed) JOIN v USING (seed) LEFT JOIN tri USING (seed)""".replace(", e AS", ",\ne AS", 1))
def _(spark, d):
    f = I.features(*_identity(spark, d))
    return f.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


MORE = """w AS (SELECT o_orderkey AS app_id, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
 sz AS (SELECT seed, count(*) AS n FROM im GROUP BY seed), ed AS (SELECT seed, count(*) AS m FROM il GROUP BY seed), dgr AS (SELECT seed, max(k) AS max_degree FROM (SELECT seed, x, count(*) AS k FROM (SELECT seed, u AS x FROM il UNION ALL SELECT seed, v FROM il) GROUP BY ALL) GROUP BY seed),
 ex AS (SELECT seed, count(*) AS n_external FROM (SELECT DISTINCT im.seed, y.app_id FROM im JOIN fa x ON x.app_id = im.app_id JOIN fa y USING (attribute, value) WHERE (im.seed, y.app_id) NOT IN (SELECT (seed, app_id) FROM im)) GROUP BY seed),
 fo AS (SELECT seed, max(held) FILTER (attribute = 'pan') AS max_pan_fanout, max(held) FILTER (attribute = 'phone') AS max_phone_fanout, max(held) FILTER (attribute = 'address') AS max_address_fanout, avg(held) AS mean_fanout FROM im JOIN apps USING (app_id) JOIN held USING (attribute, value) GROUP BY seed),
 tg AS (SELECT seed, day, day - lag(day) OVER (PARTITION BY seed ORDER BY day) AS gap, count(*) OVER (PARTITION BY seed ORDER BY day RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS near FROM im JOIN w USING (app_id)),
 tm AS (SELECT seed, max(day) - min(day) AS span_days, avg(gap) AS mean_gap_days, max(gap) AS max_gap_days, max(near) * 1.0 / count(*) AS burst_index FROM tg GROUP BY seed),
 atr AS (SELECT seed, count(DISTINCT a) AS kinds FROM (SELECT seed, unnest(attributes) AS a FROM il) GROUP BY seed), mx AS (SELECT seed, max(size) AS mx FROM gr GROUP BY seed)"""


@query("ft_identity_more", ctes(APPS, IDENT, MORE) + """SELECT seed, 1::BIGINT AS n_components, CASE WHEN m = n * (n - 1) / 2 THEN 1 ELSE 2 END::BIGINT AS diameter, max_degree, max_pan_fanout, max_phone_fanout, max_address_fanout, round(mean_fanout, 6) AS mean_fanout, span_days::DOUBLE AS span_days, round(mean_gap_days, 6) AS mean_gap_days, max_gap_days::DOUBLE AS max_gap_days, round(burst_index, 6) AS burst_index,
 1.0::DOUBLE AS largest_component_share, n::DOUBLE AS mean_component_size, round(coalesce(n_external, 0) * 1.0 / n, 6) AS boundary_ratio, kinds AS n_link_attributes, round(mx * 1.0 / n, 6) AS spanning_attribute_share, round(coalesce(closed * 1.0 / nullif(open + closed, 0), 0), 6) AS triangle_density
 FROM sz JOIN ed USING (seed) JOIN dgr USING (seed) LEFT JOIN ex USING (seed) JOIN fo USING (seed) JOIN tm USING (seed) JOIN atr USING (seed) JOIN mx USING (seed) LEFT JOIN tri USING (seed)""")
def _(spark, d):
    m, apps = _identity(spark, d)
    f = I.all_features(m, apps, R.application_times(spark, d))
    old = set(I.features(m, apps).columns) - {"seed"}
    return f.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in f.dtypes if c not in old])


@query("flt_excluded_features", ctes(APPS, IDENT, MORE) + "SELECT seed, max_address_fanout, max_degree, round(mean_fanout, 6) AS mean_fanout FROM fo JOIN dgr USING (seed)")
def _(spark, d):
    m, apps = _identity(spark, d)
    f = I.all_features(m, apps, R.application_times(spark, d))
    seen = [c for c in I.feature_names(f) if "fanout" in c or c == "max_degree"]
    return f.select("seed", *[F.round(c, 6).alias(c) if dict(f.dtypes)[c] == "double" else c for c in seen])


@query("ag_attribute_ceilings", ctes(APPS) + "SELECT attribute, max(CASE WHEN app_id % 17 <> 0 THEN n ELSE 0 END) AS legit_max, max(CASE WHEN app_id % 17 = 0 THEN n ELSE 0 END) AS fraud_max, attribute IN ('pan', 'phone') AS excluded FROM apps JOIN (SELECT attribute, value, count(*) AS n FROM apps GROUP BY ALL) USING (attribute, value) GROUP BY attribute")
def _(spark, d):
    apps = R.applications(spark, d)
    return I.ceilings(apps, apps.select("app_id", (F.col("app_id") % 17 == 0).cast("int").alias("fraud")).distinct())


@query("cs_identity_action", ctes(APPS, IDENT) + "SELECT seed, n_rare, CASE WHEN n_rare >= 3 AND n_attr >= 2 THEN 'REQUEST_STEP_UP_KYC' WHEN n_rare >= 1 THEN 'MANUAL_REVIEW' ELSE 'MONITOR' END AS action FROM (SELECT seed, count(*) FILTER (held <= 5) AS n_rare, count(DISTINCT attribute) FILTER (held <= 5) AS n_attr FROM gr JOIN held USING (attribute, value) GROUP BY seed)")
def _(spark, d):
    m, apps = _identity(spark, d)
    return I.recommended(I.groups(m, apps), apps)


MEMBERS = """dg AS (SELECT now, seed, node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT now, seed, src AS node, cnt AS o, 0 AS i FROM inr UNION ALL SELECT now, seed, dst, 0, cnt FROM inr) GROUP BY now, seed, node),
 cm AS (SELECT now, key, node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, CASE WHEN n_in > 0 AND n_out > 0 THEN 'PASS_THROUGH' WHEN n_out > 0 THEN 'SOURCE' WHEN n_in > 0 THEN 'SINK' ELSE 'ISOLATED' END AS role FROM cand JOIN mem2 USING (now, seed) LEFT JOIN dg USING (now, seed, node)),
 book AS (SELECT c.now, c.key, e.seq, e.src, e.dst, e.t, e.amount FROM cand c JOIN mem2 a ON a.now = c.now AND a.seed = c.seed JOIN edges e ON e.src = a.node AND e.t BETWEEN c.now - 360 AND c.now JOIN mem2 b ON b.now = c.now AND b.seed = c.seed AND b.node = e.dst)"""


@query("cs_case_file", ctes(*TO_CAND, MEMBERS) + "SELECT *, CAST(row_number() OVER (PARTITION BY now, key ORDER BY CASE WHEN role = 'PASS_THROUGH' THEN 0 ELSE 1 END, -(n_in + n_out), node) AS INT) AS place FROM cm")
def _(spark, d):
    cand, _, inner, _ = _inner(spark, d)
    return K.members(cand, inner)


@query("jn_case_txns", ctes(*TO_CAND, MEMBERS) + "SELECT now, key, seq FROM book")
def _(spark, d):
    return K.ledger(_inner(spark, d)[0], R.edges(spark, d), config.WINDOW).select("now", "key", "seq")


@query("nv_str", ctes(*TO_CAND, MEMBERS) + """SELECT m.now, m.key, concat_ws(' ', 'The case covers ' || n || ' accounts [CASE-' || m.now || '].', CASE WHEN mules > 0 THEN mules || ' of them pass value through [CASE-' || m.now || '].' END, CASE WHEN txns > 0 THEN 'They exchanged ' || txns || ' payments of ' || format('{:,.2f}', total) || ' in all [TXN-' || lpad(CAST(first AS VARCHAR), 8, '0') || '].' END, 'A person decides.') AS text
 FROM (SELECT now, key, count(*) AS n, count(*) FILTER (role = 'PASS_THROUGH') AS mules FROM cm GROUP BY now, key) m LEFT JOIN (SELECT now, key, count(*) AS txns, sum(amount) AS total, min(seq) AS first FROM book GROUP BY now, key) t USING (now, key)""")
def _(spark, d):
    cand, _, inner, _ = _inner(spark, d)
    return K.narrative(K.members(cand, inner), K.ledger(cand, R.edges(spark, d), config.WINDOW))


@query("nv_verify", r"SELECT doc_id, CAST(len(list_filter(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), lambda s: regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '\[[A-Z]+-[0-9]+\]'))) AS INT) AS n_uncited FROM documents")
def _(spark, d):
    return K.uncited(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n_uncited")


VERDICTS = """ver AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 = 0 THEN 'control' ELSE 'primary' END AS lane, CASE o_orderstatus WHEN 'F' THEN 'confirmed_ring' WHEN 'O' THEN 'false_positive' ELSE 'insufficient_evidence' END AS verdict, o_totalprice, o_custkey FROM orders),
 ct AS (SELECT case_id, lane, verdict, unnest(['conservation', 'cycle', 'burstiness']) AS term, unnest([CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END]) AS v FROM ver WHERE verdict NOT IN ('pending', 'insufficient_evidence')),
 te AS (SELECT term, sum(CASE WHEN v > 0 THEN w ELSE 0.0 END)::DOUBLE AS fired_n, sum(CASE WHEN v > 0 THEN w * y ELSE 0.0 END)::DOUBLE AS fired_positive, sum(CASE WHEN v > 0 THEN 0.0 ELSE w END)::DOUBLE AS not_fired_n, sum(CASE WHEN v > 0 THEN 0.0 ELSE w * y END)::DOUBLE AS not_fired_positive, count(*) FILTER (v > 0) AS raw_fired, count(*) FILTER (v <= 0) AS raw_not_fired FROM (SELECT *, CASE WHEN lane = 'control' THEN 10.0 ELSE 1.0 END AS w, CASE WHEN verdict = 'confirmed_ring' THEN 1.0 ELSE 0.0 END AS y FROM ct) GROUP BY term),
 tr AS (SELECT *, fired_positive / fired_n AS rate_fired, not_fired_positive / not_fired_n AS rate_not_fired, (fired_positive / fired_n) / (not_fired_positive / not_fired_n) AS lift FROM te)"""


def _cases(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    flag = lambda c: c.cast("double")
    contrib = F.create_map(F.lit("conservation"), flag(F.col("o_totalprice") > 200000), F.lit("cycle"), flag(F.col("o_custkey") % 7 == 0), F.lit("burstiness"), flag(F.col("o_custkey") % 2 == 0))
    verdict = F.when(F.col("o_orderstatus") == "F", "confirmed_ring").when(F.col("o_orderstatus") == "O", "false_positive").otherwise("insufficient_evidence")
    return o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 10 == 0, "control").otherwise("primary").alias("lane"), verdict.alias("verdict"), contrib.alias("contrib"))


@query("ag_term_evidence", ctes(VERDICTS) + "SELECT * FROM te")
def _(spark, d):
    return K.term_evidence(_cases(spark, d))


@query("hp_term_rates", ctes(VERDICTS) + "SELECT term, round(rate_fired, 6) AS rate_fired, round(rate_not_fired, 6) AS rate_not_fired, round(lift, 6) AS lift, round(raw_fired * 1.0 / (raw_fired + raw_not_fired), 6) AS prevalence FROM tr")
def _(spark, d):
    r = K.term_rates(K.term_evidence(_cases(spark, d)))
    return r.select("term", *[F.round(c, 6).alias(c) for c in ("rate_fired", "rate_not_fired", "lift", "prevalence")])


@query("ag_store_stats", ctes(VERDICTS) + "SELECT lane, verdict, count(*) AS n FROM ver GROUP BY lane, verdict")
def _(spark, d):
    return _cases(spark, d).groupBy("lane", "verdict").agg(F.count("*").alias("n"))


@query("cs_dispose", "SELECT user_id AS case_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS verdict, count(*) AS n_events FROM events GROUP BY user_id")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("case_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("verdict"))
    return K.verdicts_folded(e)


@query("fn_ids", "SELECT o_orderkey, 'APP-' || lpad(o_orderkey::VARCHAR, 8, '0') AS app_ref, 'USD ' || format('{:,.2f}', o_totalprice) AS amount FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.format_string("APP-%08d", "o_orderkey").alias("app_ref"), F.concat(F.lit("USD "), F.format_number("o_totalprice", 2)).alias("amount"))
