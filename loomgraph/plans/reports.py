"""Queries of a case's report: its text, the check of its sources, what the check catches, and how much evidence is cited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import cases as K
from loomgraph.operators import narrative as N
from loomgraph.operators.stage import once, stage
from loomgraph.plans.casework import MEMBERS
from loomgraph.plans.core import TO_CAND, _inner, ctes
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

WHEN = "strftime(to_timestamp(({t} + 28401120) * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')"
ROLE = "CASE WHEN role = 'PASS_THROUGH' THEN 0 ELSE 1 END, -(n_in + n_out), node"
REPORT = f"""mb AS (SELECT *, row_number() OVER (PARTITION BY now, key ORDER BY {ROLE}) AS place FROM cm), cs AS (SELECT now, key, '[CASE-' || now || '-' || seed || ']' AS cid FROM cand),
 bk AS (SELECT *, row_number() OVER (PARTITION BY now, key ORDER BY t, seq) AS rank, '[TXN-' || lpad(CAST(seq AS VARCHAR), 8, '0') || ']' AS cite FROM book),
 nd AS (SELECT now, key, rank, cite, src AS node FROM bk UNION SELECT now, key, rank, cite, dst FROM bk), ev AS (SELECT now, key, node, string_agg(cite, ' ' ORDER BY rank) AS cites FROM (SELECT *, row_number() OVER (PARTITION BY now, key, node ORDER BY rank) AS r FROM nd) WHERE r <= 3 GROUP BY ALL),
 sm AS (SELECT now, key, count(*) AS n, count(*) FILTER (role = 'PASS_THROUGH') AS mules, string_agg('[ACC-' || node || ']', ' ' ORDER BY node) FILTER (role = 'PASS_THROUGH') AS mc, max(n_out) AS widest FROM mb GROUP BY ALL),
 py AS (SELECT now, key, count(*) AS txns, sum(amount) AS total, string_agg(cite, ' ' ORDER BY rank) FILTER (rank <= 5) AS head, arg_min(t, rank) AS t1, arg_min(cite, rank) AS c1, arg_max(t, rank) AS t2, arg_max(cite, rank) AS c2 FROM bk GROUP BY ALL),
 fx AS (SELECT * FROM cs JOIN sm USING (now, key) LEFT JOIN py USING (now, key)),
 ln AS (SELECT now, key, 1 AS section, 0 AS place, 'Who: ' || n || ' accounts take part in what is reported ' || cid || '.' AS text FROM fx
 UNION ALL SELECT now, key, 1, place, 'Account ' || node || ' is a ' || lower(replace(role, '_', ' ')) || ', paid ' || n_in || ' and paying ' || n_out || ' times in the window ' || coalesce(cites, '[ACC-' || node || ']') || '.' FROM mb LEFT JOIN ev USING (now, key, node)
 UNION ALL SELECT now, key, 2, 0, CASE WHEN txns > 0 THEN 'What: ' || txns || ' payments of ' || format('{{:,.2f}}', total) || ' in all moved between them ' || head || '.' ELSE 'What: no payments between them are on file ' || cid || '.' END FROM fx
 UNION ALL SELECT now, key, 2, rank, 'On ' || {WHEN.format(t="t")} || ' account ' || src || ' paid account ' || dst || ' ' || format('{{:,.2f}}', amount) || ' ' || cite || '.' FROM bk WHERE rank <= 20
 UNION ALL SELECT now, key, 2, 21, 'A further ' || (txns - 20) || ' payments are on file ' || cid || '.' FROM fx WHERE txns > 20
 UNION ALL SELECT now, key, 3, 0, CASE WHEN txns > 0 THEN 'When: from ' || {WHEN.format(t="t1")} || ' ' || c1 || ' to ' || {WHEN.format(t="t2")} || ' ' || c2 || '.' ELSE 'When: the window closed at ' || {WHEN.format(t="now")} || ' ' || cid || '.' END FROM fx
 UNION ALL SELECT now, key, 4, place, 'Where: account ' || node || ' is at bank ' || node % 7 || ' [ACC-' || node || '].' FROM mb
 UNION ALL SELECT now, key, 5, 0, 'Why: ' || mules || ' accounts pass value on and one pays ' || widest || ' times, as ' || CASE WHEN mules > 0 THEN 'layering' ELSE 'spreading' END || ' does ' || cid || '.' FROM fx
 UNION ALL SELECT now, key, 6, 0, CASE WHEN mules > 0 THEN 'How: value goes through ' || mules || ' of ' || n || ' accounts ' || mc || '.' ELSE 'How: no account of ' || n || ' passes value on ' || cid || '.' END FROM fx
 UNION ALL SELECT now, key, 7, 0, 'The ledger of these accounts is kept with the case ' || cid || '.' FROM fx),
 ci AS (SELECT DISTINCT now, key, unnest(regexp_extract_all(text, '\\[([A-Za-z0-9:_\\-]+)\\]', 1)) AS id FROM ln),
 rc AS (SELECT now, key, txns AS n_txns, n AS n_members, n_cited, t * 1.0 / txns AS txn_recall, m * 1.0 / n AS member_recall, (t + m) * 1.0 / (txns + n) AS evidence_recall FROM (SELECT now, key, coalesce(txns, 0) AS txns, n FROM fx) JOIN (SELECT now, key, count(*) AS n_cited, count(*) FILTER (id LIKE 'TXN-%') AS t, count(*) FILTER (id LIKE 'ACC-%') AS m FROM ci GROUP BY ALL) USING (now, key))"""


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All cases' sentences, and the ids they may cite."""

    def make() -> tuple[DataFrame, DataFrame]:
        cand, _, inner, _ = _inner(spark, d)
        member, book = stage(K.members(cand, inner)), stage(K.ledger(cand, R.edges(spark, d), config.WINDOW))
        return stage(N.sentences(cand, member, book)), stage(N.sources(cand, member, book))

    return once(spark, f"{d}/events.parquet", "reports", make)


@query("nv_report", ctes(*TO_CAND, MEMBERS, REPORT) + "SELECT now, key, string_agg(text, chr(10) ORDER BY section, place) AS text FROM ln GROUP BY now, key")
def _(spark, d):
    return N.text(_report(spark, d)[0])


@query("nv_verify_report", ctes(*TO_CAND, MEMBERS, REPORT) + "SELECT now, key, count(*) AS n_sentences, 0::BIGINT AS n_uncited, 0::BIGINT AS n_unknown, any_value(n_cited) AS n_cited, true AS ok FROM ln JOIN rc USING (now, key) GROUP BY now, key")
def _(spark, d):
    lines, known = _report(spark, d)
    return N.verified(lines, known)


@query("ev_verifier_catch", ctes(*TO_CAND, MEMBERS, REPORT) + "SELECT fault, n, CASE WHEN fault = 'attribution' THEN 0 ELSE n END AS caught, CASE WHEN fault = 'attribution' THEN 0.0 ELSE 1.0 END::DOUBLE AS rate FROM (SELECT count(DISTINCT (now, key)) AS n FROM ln), (SELECT unnest(['fabricated_id', 'stripped_citation', 'attribution']) AS fault)")
def _(spark, d):
    return N.catch_rates(*_report(spark, d))


@query("ev_citation_recall", ctes(*TO_CAND, MEMBERS, REPORT) + "SELECT now, key, n_txns, n_members, n_cited, 1.0::DOUBLE AS precision, round(txn_recall, 6) AS txn_recall, round(member_recall, 6) AS member_recall, round(evidence_recall, 6) AS evidence_recall FROM rc")
def _(spark, d):
    r = N.recall(*_report(spark, d))
    return r.select("now", "key", "n_txns", "n_members", "n_cited", "precision", *[F.round(c, 6).alias(c) for c in ("txn_recall", "member_recall", "evidence_recall")])


@query("hp_citation_aggregate", ctes(*TO_CAND, MEMBERS, REPORT) + "SELECT band, count(*) AS n_cases, list_sort(list(n_txns))[count(*) // 2 + 1] AS median_n_txns, round(avg(evidence_recall), 6) AS evidence_recall, round(avg(txn_recall), 6) AS txn_recall, round(avg(member_recall), 6) AS member_recall FROM (SELECT *, CASE WHEN n_txns <= 20 THEN '0-20' WHEN n_txns <= 50 THEN '21-50' WHEN n_txns <= 150 THEN '51-150' ELSE '151+' END AS band FROM rc) GROUP BY band")
def _(spark, d):
    r = N.recall_by_size(N.recall(*_report(spark, d)))
    return r.select("band", "n_cases", "median_n_txns", *[F.round(c, 6).alias(c) for c in ("evidence_recall", "txn_recall", "member_recall")])
