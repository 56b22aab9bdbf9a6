"""Queries of operators that hold for one hot key, many patterns or terms, many events and several tables at once, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.operators import matching as M
from leakloom.operators import paging as K
from leakloom.operators import people as P
from leakloom.operators import sketches as S
from leakloom.operators import snapshots
from leakloom.operators import store as O
from leakloom.operators.cuts import Cuts, shared_dir
from leakloom.streaming import timers as Q

from . import views as V
from .catalog import ORACLE_SQL, c, q, tables
from .views import ORACLE_VIEWS

docs = lambda s, d: V.table(s, d, "documents")

# chains of committers, each waiting for the one before: sequential by nature, followed by doubling
_CHAIN = "committers AS (SELECT c_custkey % 5 AS repo, 'n' || ((c_custkey // 5 + 1) // 2) AS name, 'e' || ((c_custkey // 5) // 2) AS email, c_custkey AS id FROM customer)"
_GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS i FROM committers),
r AS (SELECT repo, i, id, [name] AS ns, [email] AS ms, true AS keep FROM o WHERE i = 1 UNION ALL
  SELECT o.repo, o.i, o.id, CASE WHEN list_contains(ns, name) OR list_contains(ms, email) THEN ns ELSE list_append(ns, name) END,
    CASE WHEN list_contains(ns, name) OR list_contains(ms, email) THEN ms ELSE list_append(ms, email) END, NOT (list_contains(ns, name) OR list_contains(ms, email)) FROM r JOIN o ON o.repo = r.repo AND o.i = r.i + 1)"""
q("ded05_chains", None, lambda s, d: V.table(s, d, "customer"))(
    lambda d: P.committers_first_seen(
        d.select((c("c_custkey") % 5).alias("repo"), F.expr("concat('n', (c_custkey div 5 + 1) div 2)").alias("name"), F.expr("concat('e', (c_custkey div 5) div 2)").alias("email"), c("c_custkey").alias("seq"))
    )
)
ORACLE_SQL["ded05_chains"] = f"WITH RECURSIVE {_CHAIN}, {_GREEDY} SELECT o.repo, o.name, o.email, o.id AS seq FROM o JOIN r USING (repo, i) WHERE keep"

# patterns and terms of tables
_PATTERN = (
    "CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN concat('https://github[.]com/org', s_suppkey % 20, '/repo', s_suppkey % 97) WHEN 1 THEN concat('(?i)HTTPS://GITLAB[.]COM/org', s_suppkey % 20, '/repo[0-9]+')"
    " WHEN 2 THEN concat('.*/org', s_suppkey % 20, '/repo', s_suppkey % 97) WHEN 3 THEN concat('https://(example|bitbucket)[.]org/org', s_suppkey % 20, '/(repo)?', 'repo[1-9]') ELSE concat('.*[a-z]', s_suppkey % 97) END"
)
q("j02_many_patterns", f", p AS (SELECT DISTINCT {_PATTERN} AS term FROM supplier), u AS (SELECT DISTINCT url FROM incidents) SELECT url, term FROM u, p WHERE regexp_full_match(url, term)", tables("incidents", "supplier"))(
    lambda t: M.matched_patterns(t[0].select("url"), t[1].select(F.expr(_PATTERN).alias("term")))
)
q("j02_unexcluded", f", p AS (SELECT DISTINCT {_PATTERN} AS term FROM supplier) SELECT id, url FROM incidents WHERE url NOT IN (SELECT url FROM (SELECT DISTINCT url FROM incidents) u, p WHERE regexp_full_match(url, term))", tables("incidents", "supplier"))(
    lambda t: t[0].select("id", "url").join(M.matched_patterns(t[0].select("url"), t[1].select(F.expr(_PATTERN).alias("term"))).select("url").distinct(), "url", "left_anti").select("id", "url")
)
_WORDS = "SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 4"
_words = lambda b: b.select(F.explode(F.split("text", " ")).alias("term")).where(F.length("term") >= 4)
q("j10_terms_in_texts", None, tables("documents", "benchmark"))(
    lambda t: M.terms_in(t[0], _words(t[1])).select("doc_id", "term", "first")
)
ORACLE_SQL["j10_terms_in_texts"] = f"WITH t AS ({_WORDS}), d AS (SELECT doc_id, lower(text) AS text FROM documents) SELECT doc_id, term, position(term IN text) AS first FROM d, t WHERE contains(text, term)"
q("j11_first_term", None, tables("documents", "benchmark"))(lambda t: M.first_term(M.terms_in(t[0], _words(t[1])), _words(t[1]).select("term", F.length("term").alias("at"))))
ORACLE_SQL["j11_first_term"] = f"WITH t AS ({_WORDS}), d AS (SELECT doc_id, lower(text) AS text FROM documents) SELECT doc_id, term FROM d, t WHERE contains(text, term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(term), term) = 1"

_LINE_KEY = "file || ':' || line_no"
q("str13_terms_in_lines", f", t AS ({_WORDS}), l AS (SELECT {_LINE_KEY} AS line, lower(text) AS text FROM repo_lines WHERE length(trim(text)) BETWEEN 1 AND 1000) SELECT line, term, position(term IN text) AS first FROM l, t WHERE contains(text, term)", tables("repo_lines", "benchmark"))(
    lambda t: M.terms_in(t[0].where(F.length(F.trim("text")).between(1, 1000)).select(F.concat_ws(":", "file", "line_no").alias("line"), "text"), _words(t[1]), "line").select("line", "term", "first")
)

# sketches of days against exact counts: the estimates lie within the stated bounds, also when days came in two loads
_SKETCHED = "SELECT count(*) AS n, count(DISTINCT CASE WHEN company_id <> 0 THEN company_id END) AS companies, count(DISTINCT url) AS urls, true AS companies_near, true AS urls_near, true AS levels_near FROM incidents WHERE CAST(found_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"


def _sketched(d: DataFrame) -> DataFrame:
    day = lambda x: F.to_date(F.lit(x))
    stored = S.appended(S.daily(d.where("id % 3 > 0")), d.where("id % 3 = 0"))
    got = S.period(stored, day("2024-01-05"), day("2024-01-20")).select(F.lit(1).alias("one"), *(F.col(x).alias(f"e_{x}") for x in ("n", "companies", "urls", "levels")))
    real = d.where(F.to_date("found_at").between(day("2024-01-05"), day("2024-01-20")))
    exact = real.agg(F.count("*").alias("n"), F.countDistinct(F.when(c("company_id") != 0, c("company_id"))).alias("companies"), F.countDistinct("url").alias("urls"))
    below = [F.array(F.avg((c("level") < F.get("e_levels", F.lit(i))).cast("int")), F.avg((c("level") <= F.get("e_levels", F.lit(i))).cast("int"))) for i in (0, 1)]
    ranks = real.withColumn("one", F.lit(1)).join(got, "one").agg(*(b.alias(f"r{i}") for i, b in enumerate(below)))
    near = lambda x: F.abs(c(f"e_{x}") - c(x)) <= c(x) * S.COUNT_ERROR
    rank_near = lambda x, p: (F.get(c(x), F.lit(0)) <= p + S.RANK_ERROR) & (F.get(c(x), F.lit(1)) >= p - S.RANK_ERROR)
    one = lambda x: x.withColumn("one", F.lit(1))
    both = one(exact).join(got, "one").join(one(ranks), "one")  # a row each
    return both.select("n", "companies", "urls", near("companies").alias("companies_near"), near("urls").alias("urls_near"), F.coalesce(rank_near("r0", 0.5) & rank_near("r1", 0.9) & (c("n") == c("e_n")), c("n") == 0).alias("levels_near"))


q("agg06_sketched", _SKETCHED)(_sketched)

# a page far behind, by a stored index of keys
q("src01_keyset_page", "SELECT id, url, level FROM incidents ORDER BY id LIMIT 25 OFFSET 225")(
    lambda d: K.page_of(d.select("id", "url", "level"), Cuts(d.sparkSession)(K.page_index(d, "id", 25)), 9, "id", 25)
)


# many addresses at once, in a table laid out by their hash
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, place = V.incidents(spark, sf_dir), f"{shared_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    K.write_bucketed(d.where("level = 3").select("url"), place, "url", 32)
    return K.Bucketed(spark, place, "url", 32).unseen(d.select("id", "url"))


q("j01_unseen_bucketed", "SELECT id, url FROM incidents a WHERE NOT EXISTS (SELECT 1 FROM incidents b WHERE b.level = 3 AND b.url = a.url)", lambda s, d: (s, d))(lambda a: looked_up(*a))

# quotas at a moment: resets and blocks that have passed by then
_ANSWERS = """SELECT concat('t', CAST(user_id % 7 AS VARCHAR(9))) AS token, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'core' WHEN 1 THEN 'search' ELSE 'graphql' END AS resource, CAST({epoch} AS BIGINT) AS "at",
CASE WHEN event_id % 5 > 0 THEN 5000 + event_id % 10 END AS "limit", CASE WHEN event_id % 4 <> 1 THEN event_id % 4000 END AS remaining,
CASE WHEN event_id % 7 <> 2 THEN CAST({epoch} AS BIGINT) + 600 * (event_id % 90) END AS reset, CASE WHEN event_id % 11 = 0 THEN CAST({epoch} AS BIGINT) + 30000 END AS blocked_until FROM events"""
_NOW = 1705276800  # 15 January 2024
ORACLE_SQL["stm06_quotas_at"] = f"""
WITH a AS (SELECT * FROM ({_ANSWERS.format(epoch="floor(epoch(ts))")}) WHERE "at" <= {_NOW}),
g AS (SELECT token, resource, max("at") AS seen, max({{'a': "at", 'v': "limit"}}) FILTER ("limit" IS NOT NULL) AS l, max({{'a': "at", 'v': remaining}}) FILTER (remaining IS NOT NULL) AS m,
  max({{'a': "at", 'v': reset}}) FILTER (reset IS NOT NULL) AS r, max({{'a': "at", 'v': blocked_until}}) FILTER (blocked_until IS NOT NULL) AS b FROM a GROUP BY ALL)
SELECT token, resource, l.v AS "limit", CASE WHEN r.v <= {_NOW} AND coalesce(m.a, -1) < r.v THEN coalesce(l.v, m.v) ELSE m.v END AS remaining, r.v AS reset, coalesce(b.v > {_NOW}, false) AS blocked FROM g WHERE seen + {Q.IDLE} > {_NOW}
"""
q("stm06_quotas_at", None, lambda s, d: V.table(s, d, "events"))(lambda d: Q.quotas_at(d.selectExpr(*_answer_columns()), F.lit(_NOW)))


def _answer_columns() -> list[str]:
    epoch = "unix_seconds(cast(ts as timestamp))"
    return [
        "concat('t', user_id % 7) as token", "case event_id % 3 when 0 then 'core' when 1 then 'search' else 'graphql' end as resource", f"{epoch} as at", "case when event_id % 5 > 0 then 5000 + event_id % 10 end as limit",
        "case when event_id % 4 <> 1 then event_id % 4000 end as remaining", f"case when event_id % 7 <> 2 then {epoch} + 600 * (event_id % 90) end as reset", f"case when event_id % 11 = 0 then {epoch} + 30000 end as blocked_until",
    ]


# a store of several tables: two loads and a repeated one, published as snapshots
_NEW = "SELECT url, min(id) AS id, min_by(level, id) AS level FROM incidents GROUP BY url"


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table, url, id of the last snapshot."""
    first = V.incidents(spark, sf_dir).groupBy("url").agg(F.min("id").alias("id"), F.min_by("level", "id").alias("level"))
    store = snapshots.Store(spark, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    report = lambda d: d.select("url", c("id").alias("leak_id"))
    old, new = first.where("level <= 1"), first.where("level > 1")
    store.publish("list", 0, lambda t: {"leak": old, "raw_report": report(old)})
    for _ in range(2):  # the second is a replay
        store.publish("list", 1, lambda t: {"leak": O.updated(t["leak"], t["leak"].where("level = 0").select("id", F.lit(9).alias("level"))).unionByName(new)}, {"raw_report": report(new)})
    t = store.tables()
    return t["leak"].select(F.lit("leak").alias("table"), "url", "id", c("level").cast("int").alias("level")).unionByName(t["raw_report"].select(F.lit("raw_report").alias("table"), "url", c("leak_id").alias("id"), F.lit(None).cast("int").alias("level")))


q("snk04_published", None, lambda s, d: (s, d))(lambda a: published(*a))
ORACLE_SQL["snk04_published"] = ORACLE_VIEWS + f", f AS ({_NEW}) SELECT 'leak' AS \"table\", url, id, CAST(CASE level WHEN 0 THEN 9 ELSE level END AS INT) AS level FROM f UNION ALL SELECT 'raw_report', url, id, NULL FROM f"
