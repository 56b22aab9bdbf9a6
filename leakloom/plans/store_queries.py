"""Queries of the store, its loads, and of reports, lists, quotas and captured pages, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import documents as J
from leakloom.functions import paths as P
from leakloom.functions import text as T
from leakloom.operators import reports as R
from leakloom.operators import store as O
from leakloom.operators import tables as D
from leakloom.operators.people import committers_first_seen
from leakloom.sources import lists as L
from leakloom.sources import pages as G
from leakloom.streaming import quota as Q

from . import views as V
from .catalog import c, q, tables

_by_table = lambda n: lambda s, d: V.table(s, d, n)
_ids = "row_number() OVER (ORDER BY left(md5({k}), 3), {k})"

# requests and writes
q("src07_request", "SELECT s_suppkey AS id, s_name AS company_name, s_name AS name FROM supplier ORDER BY id LIMIT 20 OFFSET 2", _by_table("supplier"))(lambda d: O.request({"companies": d.select(c("s_suppkey").alias("id"), c("s_name").alias("company_name"))}, "company", {}, 20, 2))
q("src05_bulk_lookup", "SELECT b.url, min(a.id) AS id FROM (SELECT DISTINCT url FROM incidents WHERE level = 3) b LEFT JOIN incidents a ON a.url = b.url AND a.level = 0 GROUP BY b.url")(lambda d: O.ids_of(d.where("level = 3"), d.where("level = 0")))
q("src06_last_list", "SELECT company_id, unnest(string_split(dork, ', ')) AS term FROM (SELECT id % 20 AS company_id, max_by(leak_type || ', ' || url, id) AS dork FROM incidents GROUP BY 1)")(lambda d: O.current_terms(d.select("id", (c("id") % 20).alias("company_id"), F.base64(F.encode(F.concat_ws(", ", "leak_type", "url"), "UTF-8")).alias("dork"))))
q("snk01_inserted", f"SELECT s_suppkey AS id, s_name AS account, 0 AS need_monitor FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + {_ids.format(k='account')}, account, need_monitor FROM (SELECT c_name AS account, c_custkey % 2 AS need_monitor FROM customer)", tables("supplier", "customer"))(
    lambda t: O.inserted(t[0].select(c("s_suppkey").alias("id"), c("s_name").alias("account"), F.lit(0).cast("long").alias("need_monitor")), t[1].select(c("c_name").alias("account"), (c("c_custkey") % 2).alias("need_monitor"), c("c_custkey").alias("seq")).unionByName(t[0].select(c("s_name").alias("account"), F.lit(9).cast("long").alias("need_monitor"), F.lit(0).cast("long").alias("seq"))), "account")
)
q("snk02_updated", "SELECT id, CASE WHEN id % 3 = 0 THEN 9 ELSE level END AS level, url FROM incidents")(lambda d: O.updated(d.select("id", "level", "url"), d.where("id % 3 = 0").select("id", F.lit(9).alias("level"))))
_BATCH = "known AS (SELECT url, min_by(id, id) AS kid, min_by(result, id) AS kres FROM incidents WHERE level > 0 GROUP BY url), b AS (SELECT id AS seq, url, CASE leak_type WHEN 'misc' THEN 'None' ELSE leak_type END AS leak_type FROM incidents WHERE level = 0)"


def _load(d):
    batch = d.where("level = 0").select(c("id").alias("seq"), "url", F.when(c("leak_type") == "misc", "None").otherwise(c("leak_type")).alias("leak_type"))
    add, old = O.split_load(batch, d.where("level > 0").select("id", "url", "result"))
    return add.select(F.lit("add").alias("action"), "url", "seq").unionByName(old.select(F.lit("update").alias("action"), "url", c("id").alias("seq")))


q("snk03_batch_load", f", {_BATCH} SELECT 'add' AS action, url, min(seq) AS seq FROM b WHERE url NOT IN (SELECT url FROM known) AND leak_type <> 'None' GROUP BY url UNION ALL SELECT 'update', b.url, kid FROM b JOIN known USING (url) WHERE kres NOT IN (1, 2, 3)")(_load)


def _staged(t):
    leaks, people, sup = t
    leaks = leaks.select("url", "level").groupBy("url").agg(F.max("level").alias("level"), F.lit(0).alias("seq"))
    old = leaks.where("level = 3").select("url", "level")
    known = O.inserted(old.select(F.lit(0).cast("long").alias("id"), "url", "level").where("false"), old, "url")
    new = leaks.select("url", "level", "seq", F.lit("x").alias("raw_data"), F.lit("").alias("ai_report"), F.struct(F.lit("12").alias("size"), F.lit("yes").alias("has_wiki"), F.lit("d").alias("description")).alias("stats"))
    who = people.select(F.concat(F.lit("https://github.com/org"), c("c_custkey") % 20, F.lit("/repo"), (c("c_custkey") * 4) % 97).alias("url"), c("c_name").alias("account"), F.lit(1).alias("need_monitor"), c("c_nationkey").alias("company_id"))
    accounts = sup.select(c("s_suppkey").alias("id"), c("s_name").alias("account"), F.lit(0).alias("need_monitor"), F.lit(0).alias("related_company_id"))
    links = sup.where("false").select(c("s_suppkey").alias("leak_id"), c("s_suppkey").alias("account_id"))
    return O.staged(known, accounts, links, new, who)["related_accounts_leaks"]


q(
    "snk04_staged_links",
    f""", l AS (SELECT url, max(level) AS level FROM incidents GROUP BY url), k AS (SELECT url, {_ids.format(k='url')} AS id FROM l WHERE level = 3),
    n AS (SELECT url, (SELECT max(id) FROM k) + {_ids.format(k='url')} AS id FROM l WHERE level < 3), a AS (SELECT * FROM k UNION ALL SELECT * FROM n),
    w AS (SELECT 'https://github.com/org' || (c_custkey % 20) || '/repo' || ((c_custkey * 4) % 97) AS url, c_name AS account FROM customer),
    ac AS (SELECT account, (SELECT max(s_suppkey) FROM supplier) + {_ids.format(k='account')} AS account_id FROM (SELECT DISTINCT account FROM w))
    SELECT DISTINCT a.id AS leak_id, account_id FROM w JOIN a USING (url) JOIN ac USING (account)""",
    tables("incidents", "customer", "supplier"),
)(_staged)
q("snk05_refreshed", "SELECT id, CASE WHEN id % 2 = 0 AND id % 4 > 0 AND result NOT IN (1, 2, 3) THEN 7 ELSE level END AS level, result, leak_type FROM incidents")(
    lambda d: O.refreshed(
        d.select("id", "level", F.lit("a").alias("author_info"), "leak_type", "result", c("found_at").alias("updated_at"), c("url").alias("payload")),
        d.where("id % 2 = 0").select("id", F.lit(7).alias("level"), F.lit("a").alias("author_info"), "leak_type", "result", c("found_at").alias("updated_at"), F.when(c("id") % 4 == 0, c("url")).otherwise(F.lit("new")).alias("payload")),
    ).select("id", "level", "result", "leak_type")
)
q("agg35_counts", "SELECT leak_id, greatest(max(stored), count(DISTINCT account)) AS contributors_count FROM (SELECT c_custkey % 37 AS leak_id, (c_custkey % 37) % 5 AS stored, c_name AS account FROM customer) GROUP BY leak_id", _by_table("customer"))(
    lambda d: (lambda a: O.contributor_counts(a.select("leak_id", (c("leak_id") % 5).alias("contributors_count")).distinct(), a.where("c_custkey % 2 = 0"), a.where("c_custkey % 3 > 0 or c_custkey % 2 = 1")))(d.select("c_custkey", (c("c_custkey") % 37).alias("leak_id"), c("c_name").alias("account")))
)
q("snk06_accounts", f"SELECT s_suppkey AS id, s_name AS account, 0 AS need_monitor, 0 AS related_company_id FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + {_ids.format(k='c_name')}, c_name, CAST(c_custkey % 2 AS INT), CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END FROM customer", tables("supplier", "customer"))(
    lambda t: O.with_accounts(t[0].select(c("s_suppkey").alias("id"), c("s_name").alias("account"), F.lit(0).alias("need_monitor"), F.lit(0).alias("related_company_id")), t[1].select(c("c_name").alias("account"), (c("c_custkey") % 2).cast("int").alias("need_monitor"), F.when(c("c_custkey") % 3 == 0, F.lit("none")).otherwise(c("c_nationkey").cast("string")).alias("company_id")))
)
q("snk07_companies", f"SELECT n_name AS company_name, coalesce(CASE WHEN n_nationkey < 10 THEN n_nationkey + 1 END, r.id) AS company_id FROM nation LEFT JOIN (SELECT n_name AS nn, 10 + {_ids.format(k='n_name')} AS id FROM nation WHERE n_nationkey >= 10) r ON nn = n_name", _by_table("nation"))(
    lambda d: O.with_companies(d.where("n_nationkey < 10").select((c("n_nationkey") + 1).cast("long").alias("id"), c("n_name").alias("company_name")), d.where("false").select(c("n_name").alias("dork"), c("n_nationkey").cast("long").alias("company_id")), d.select(c("n_name").alias("company_name"), F.array(F.lower("n_name"), F.lit("leak")).alias("terms")))[2]
)
q("json04_merged", "SELECT o_custkey AS repo, 'gitleaks' AS scanner, o_orderkey AS leak, 'Match' AS field, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'O' THEN o_orderpriority ELSE o_orderstatus END AS value FROM orders", _by_table("orders"))(
    lambda d: (lambda r: O.merged_findings(r.withColumn("value", c("o_orderstatus")), r.where("leak % 2 = 0").withColumn("value", F.when(c("o_orderstatus") != "O", c("o_orderpriority")).otherwise(""))))(d.select(c("o_custkey").alias("repo"), F.lit("gitleaks").alias("scanner"), c("o_orderkey").alias("leak"), F.lit("Match").alias("field"), "o_orderstatus", "o_orderpriority"))
)
q("flt04_needs_analysis", "SELECT id, result <> 0 AND NOT (level = 3 AND result = 2) AND NOT (leak_type = 'misc' OR (leak_type LIKE '%database%' AND (contains(url, 'gitlab') OR id % 5 = 0))) AS needs FROM incidents")(
    lambda d: d.select("id", O.needs_analysis(c("result"), (c("level") == 3) & (c("result") == 2), F.when(c("leak_type") == "misc", "Oversize repository").when(c("leak_type").contains("database"), "Failed to clone"), F.regexp_replace("url", "gitlab.com", "gist.github.com"), (c("id") % 5).cast("int")).alias("needs"))
)
# each url's events in order of id: judgements and disappearances
_EV = "SELECT url, id AS seq, CASE WHEN id % 3 = 0 THEN 'gone' WHEN id % 7 = 1 THEN 'judged:9' ELSE 'judged:' || (CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 4 END) END AS kind FROM incidents"
q(
    "stm07_moves",
    f""", e AS ({_EV}), s AS (SELECT url, CAST(min_by(result, id) AS INT) AS result FROM incidents GROUP BY url), o AS (SELECT url, list(kind ORDER BY seq) AS ks FROM e GROUP BY url)
    SELECT url, list_reduce(list_prepend(CAST(result AS VARCHAR), ks), lambda a, k: CASE WHEN k IN ('judged:0', 'judged:4', 'judged:5') AND a IN ('4', '5') THEN right(k, 1) WHEN k = 'gone' AND a = '1' THEN '3' WHEN k = 'gone' AND a = '5' THEN '2' ELSE a END)::INT AS result FROM s JOIN o USING (url)""",
)(
    lambda d: O.lifecycle(
        d.groupBy("url").agg(F.min_by("result", "id").alias("result")),
        d.select("url", c("id").alias("seq"), F.when(c("id") % 3 == 0, "gone").when(c("id") % 7 == 1, "judged:9").otherwise(F.concat(F.lit("judged:"), F.when(c("id") % 4 == 0, "0").when(c("id") % 4 == 1, "5").otherwise("4"))).alias("kind")),
    )
)
q("ded08_checked", "SELECT url, min(id) AS id FROM incidents GROUP BY url")(lambda d: O.checked_once(d.select("url", "id"), "url", "id"))
q("j04_reports_of", "SELECT o_orderkey AS leak_id, o_orderpriority AS said FROM orders WHERE o_orderkey IN (SELECT id FROM incidents WHERE level >= 2)", tables("orders", "incidents"))(
    lambda t: O.with_reports(t[1].where("level >= 2"), t[0].select(c("o_orderkey").alias("leak_id"), J.encoded_blob(F.struct(c("o_orderpriority").alias("said"))).alias("raw_data"), F.lit("").alias("ai_report"))).select("leak_id", F.try_variant_get("raw", "$.said", "string").alias("said"))
)
q("j02_anti_patterns", "SELECT id, url FROM incidents WHERE NOT (regexp_full_match(url, 'https://gitlab[.]com/org[0-9]/.*') OR url IN (SELECT url FROM incidents WHERE level = 3))")(
    lambda d: L.unexcluded(d.select("id", "url"), L.with_exclusions(d.sparkSession.createDataFrame([("https://gitlab[.]com/org[0-9]/.*",)], "term string"), d.where("level = 3")))
)
q("flt01_keep", "SELECT id, url FROM incidents a WHERE contains(url, 'github.com') AND NOT EXISTS (SELECT 1 FROM incidents b WHERE b.level = 3 AND b.url = a.url) AND url NOT IN (SELECT url FROM incidents WHERE level = 2 AND result = 1)")(
    lambda d: L.unexcluded(D.unseen(d.where(c("url").contains("github.com")).select("id", "url").withColumn("norm", P.normalised_repo(c("url"))), d.where("level = 3").select(P.normalised_repo(c("url")).alias("norm")), "norm").drop("norm"), L.with_exclusions(d.sparkSession.createDataFrame([], "term string"), d.where("level = 2 and result = 1")))
)
q("flt02_rows", "SELECT id, 'https://github.com/' || user AS url FROM (SELECT id, company_id AS user, result FROM incidents) WHERE result = 5")(lambda d: d.select("id", F.concat(F.when(c("id") % 2 == 1, "https://github.com/").otherwise("https://gitlab.com/"), c("company_id")).alias("url"), "result").where((c("result") == 5) & P.valid_repo_host(c("url"))).select("id", "url"))
q("j09_products", "SELECT DISTINCT n_regionkey AS company_id, n_name || ' ' || b AS term FROM nation, (VALUES ('password'), ('token')) v(b) WHERE n_nationkey >= 3", _by_table("nation"))(lambda d: L.product_terms(d.select(c("n_regionkey").alias("company_id"), c("n_name").alias("term"), c("n_nationkey").alias("at")), ["password", "token"]))
q("set02_override", "SELECT n_regionkey AS company_id, n_name AS term FROM nation WHERE n_nationkey % 2 = 0 OR n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 2 = 0)", _by_table("nation"))(lambda d: (lambda r: L.overridden(r.where("k % 2 = 1").drop("k"), r.where("k % 2 = 0").drop("k")))(d.select(c("n_regionkey").alias("company_id"), c("n_name").alias("term"), c("n_nationkey").alias("k"))))
q("snk13_marked", "SELECT DISTINCT url FROM incidents WHERE level >= 1")(lambda d: L.marked(L.marked(d.where("false").select("url"), d.where("level = 3")), d.where("level >= 1")))

# reports
q("srt02_period_sorted", "SELECT id, found_at, row_number() OVER (ORDER BY found_at DESC, id) AS nth FROM incidents WHERE found_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")(lambda d: D.numbered(R.in_period(d, "2024-01-05", "2024-01-20").withColumn("one", F.lit(1)), ["one"], [F.desc("found_at"), "id"], "nth").select("id", "found_at", (c("nth") + 1).cast("long").alias("nth")))
q("agg10_status", "SELECT CAST(result AS VARCHAR) AS result, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percentage, result = 1 AS done FROM incidents GROUP BY result")(R.status_breakdown)
q("agg11_created_daily", "SELECT CAST(created_at AS DATE) AS day, count(*) AS cnt FROM candidates GROUP BY 1", V.candidates)(R.created_daily)
q("agg12_first_peak", "SELECT CAST(arg_max(h, n * 1000000000 - f) AS INTEGER) AS peak_hour FROM (SELECT hour(found_at) AS h, count(*) AS n, min(id) AS f FROM incidents GROUP BY 1)")(R.first_peak_hour)
q("agg21_constants", "SELECT count(*) AS total, count(DISTINCT url) AS unique_urls, greatest(1, count(*) // 20) AS false_positives, 89.4::DOUBLE AS detection_rate, 45 AS average_scan_seconds, 2.8::DOUBLE AS resolution_days FROM incidents")(R.constant_metrics)
_TECH = "CASE WHEN regexp_matches(upper(leak_type), 'API|KEY') THEN 'API Keys' WHEN regexp_matches(upper(leak_type), 'DATABASE|DB') THEN 'Database Credentials' WHEN regexp_matches(upper(leak_type), 'PRIVATE|RSA') THEN 'Private Keys' WHEN regexp_matches(upper(leak_type), 'DEBUG|LOG') THEN 'Debug Information' ELSE 'Other' END"
q("agg22_labelled", f"SELECT category, cnt, severity, CASE category WHEN 'API Keys' THEN 'high' WHEN 'Database Credentials' THEN 'critical' WHEN 'Private Keys' THEN 'critical' ELSE 'medium' END AS risk_level FROM (SELECT {_TECH} AS category, count(*) AS cnt, round(avg((level + 1) * 25.0::DOUBLE), 1) AS severity FROM incidents GROUP BY 1)")(lambda d: R.labelled_types(d).drop("locations", "patterns"))
q("agg25_errors", "SELECT count(*) FILTER (bad) AS error_reports, count(*) FILTER (NOT bad) AS successful_reports, count(*) FILTER (level = 2) AS too_large_repo_errors FROM (SELECT level, level = 3 OR level = 2 OR contains(leak_type, 'debug') AS bad FROM incidents)")(
    lambda d: R.error_analysis(d.select(F.when(c("leak_type").contains("debug"), "an Error").otherwise("fine").alias("raw"), F.try_parse_json(F.when(c("level") == 3, '{"Thinks": "Not state"}').when(c("level") == 2, '{"filters": {"a": "Repo is Too Large"}}').otherwise("{}")).alias("ai")))
)
q("agg31_nested_keys", "SELECT repo, CAST(count(DISTINCT rule) + count(*) + sum(len(string_split(match, '.'))) AS BIGINT) AS keys FROM findings GROUP BY repo", V.findings)(lambda d: R.nested_keys(d.select("repo", c("rule").alias("scanner"), F.split("match", r"\.").alias("fields"))))
q("rpt04_risk_bars", "SELECT unnest(['high', 'medium', 'low']) AS level, unnest([h, m, l]) AS repos, unnest([round(h * 100.0::DOUBLE / (h + m + l), 1), round(m * 100.0::DOUBLE / (h + m + l), 1), round(l * 100.0::DOUBLE / (h + m + l), 1)]) AS share FROM (SELECT greatest(1, count(*) // 6) AS h, greatest(1, count(*) // 4) AS m, greatest(1, count(*) // 3) AS l FROM incidents)")(lambda d: R.risk_bars(d).select("level", "repos", "share"))
q("rpt05_severity_label", "SELECT url, CASE WHEN avg(level) >= 2.5 THEN 'high' WHEN avg(level) >= 1.5 THEN 'medium' ELSE 'low' END AS label FROM incidents GROUP BY 1")(lambda d: d.groupBy("url").agg(R.severity_label(F.avg("level")).alias("label")))
q("rpt06_month_bars", "SELECT month, round(incidents * 200.0::DOUBLE / max(incidents) OVER (), 1) AS incidents_height, round(resolved * 150.0::DOUBLE / greatest(1, max(resolved) OVER ()), 1) AS resolved_height FROM (SELECT strftime(found_at, '%Y-%m') AS month, count(*) AS incidents, count(*) FILTER (result = 1) AS resolved FROM incidents GROUP BY 1 ORDER BY 1 DESC LIMIT 12)")(lambda d: R.month_bars(d).select("month", "incidents_height", "resolved_height"))
q("rpt09_efficiency", "SELECT company_id, total, efficiency, CASE WHEN efficiency >= 80 THEN 'green' WHEN efficiency >= 60 THEN 'yellow' ELSE 'red' END AS colour FROM (SELECT company_id, count(*) AS total, CAST(round(count(*) FILTER (result = 1) * 100.0::DOUBLE / count(*)) AS INT) AS efficiency FROM incidents WHERE company_id <> 0 GROUP BY 1 ORDER BY total DESC, company_id LIMIT 10)")(lambda d: R.company_efficiency(d).select("company_id", "total", "efficiency", "colour"))
q("rpt10_type_shares", "SELECT coalesce(CASE WHEN leak_type <> 'misc' THEN leak_type END, 'Unknown') AS leak_type, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percentage FROM incidents GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 10")(lambda d: R.type_shares(d.withColumn("leak_type", F.nullif("leak_type", F.lit("misc")))))
q("agg33_throughput", "SELECT round(sum(l_linenumber) / greatest(1, sum(l_quantity)), 6) AS precision, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS success_rate, round(count(*) / (sum(l_partkey) / 3600), 6) AS repos_per_hour, round(sum(l_quantity) / (sum(l_partkey) / 3600), 6) AS secrets_per_hour FROM lineitem", _by_table("lineitem"))(
    lambda d: (lambda t: t.select(*(F.round(x, 6).alias(x) for x in t.columns)))(R.throughput(d.select(c("l_partkey").alias("seconds"), c("l_quantity").alias("findings"), c("l_linenumber").alias("real"), (c("l_returnflag") == "N").alias("ok"))))
)
q("str36_shortened", "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS t FROM part", _by_table("part"))(lambda d: d.select("p_partkey", R.shortened(c("p_name"), 12).alias("t")))
q("prj03_leak_record", "SELECT doc_id AS id, CASE WHEN length(text) > 10000 THEN left(text, 10000) || '...' ELSE text END AS leak_type, coalesce(TRY_CAST(source AS INT), 0) AS company_id FROM documents", _by_table("documents"))(lambda d: d.select(c("doc_id").alias("id"), T.truncated(c("text"), 10000).alias("leak_type"), F.coalesce(c("source").try_cast("int"), F.lit(0)).alias("company_id")))

# quotas, queues and caches
_QUOTA = "SELECT user_id % 50 AS token, CASE event_type WHEN 'click' THEN 'core' WHEN 'error' THEN 'search' ELSE 'graphql' END AS resource, event_id AS tm, CAST(5000 AS BIGINT) AS \"limit\", CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS BIGINT) END AS remaining, event_id * 10 AS reset FROM events"


def _answers(d):
    kind = F.when(c("event_type") == "click", "core").when(c("event_type") == "error", "search").otherwise("graphql")
    return d.select((c("user_id") % 50).alias("token"), kind.alias("resource"), c("event_id").alias("at"), F.lit(5000).cast("long").alias("limit"), F.when(c("event_id") % 3 > 0, F.floor("value")).alias("remaining"), (c("event_id") * 10).alias("reset"))


q("stm06_quotas", f", a AS ({_QUOTA}) SELECT token, resource, max_by(\"limit\", tm) AS \"limit\", max_by(remaining, tm) FILTER (remaining IS NOT NULL) AS remaining, max_by(reset, tm) AS reset, max(tm) AS last_check FROM a GROUP BY token, resource", _by_table("events"))(lambda d: Q.quotas(_answers(d)))
q(
    "srt09_best_token",
    f""", a AS ({_QUOTA}), s AS (SELECT token, resource, max_by(remaining, tm) FILTER (remaining IS NOT NULL) AS remaining, max(reset) AS reset FROM a GROUP BY token, resource),
    o AS (SELECT *, token % 7 <> 0 AND (remaining >= CASE resource WHEN 'core' THEN 100 WHEN 'search' THEN 2 ELSE 100 END OR 2000 >= reset) AS ok FROM s)
    SELECT resource, coalesce(arg_min(token, -remaining * 1000 + token) FILTER (ok), arg_min(token, reset * 1000 + token)) AS token FROM o GROUP BY resource""",
    _by_table("events"),
)(lambda d: Q.best_token(Q.quotas(_answers(d)).withColumn("blocked_until", F.when(c("token") % 7 == 0, F.lit(10**9))), F.lit(2000)))
q("flt13_ready", "SELECT p_partkey AS name FROM part WHERE p_size % 5 < 3 AND p_size < 40 AND 100 - p_partkey % 100 >= 60 / greatest(p_partkey % 4, 1)", _by_table("part"))(
    lambda d: Q.ready_providers(d.select(c("p_partkey").alias("name"), (c("p_size") % 5).alias("error_count"), c("p_size").alias("requests_count"), F.lit(90).alias("daily_limit"), (c("p_partkey") % 100).alias("last_request"), (c("p_partkey") % 4).alias("rpm")), F.lit(100)).select("name")
)
q("stm04_queue", "SELECT id, state, CASE WHEN state = 'queued' THEN row_number() OVER (PARTITION BY state ORDER BY pr, tm, id) END AS place FROM (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS pr, ts AS tm, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 100 THEN 'queued' ELSE 'dropped' END AS state FROM events)", _by_table("events"))(
    lambda d: Q.queued(d.select(c("event_id").alias("id"), F.when(c("event_type") == "error", "high").when(c("event_type") == "click", "normal").otherwise("low").alias("priority"), c("ts").alias("submitted_at")), 100).select("id", "state", c("place").cast("long").alias("place"))
)
_cache = lambda d: d.groupBy("url").agg(F.max("found_at").alias("last_access"), F.sum("level").alias("size_bytes"))
q("stm09_evicted", "SELECT url FROM (SELECT url, max(found_at) AS t FROM incidents GROUP BY url) QUALIFY row_number() OVER (ORDER BY t DESC, url DESC) > 50")(lambda d: Q.evicted(_cache(d), 50).select("url"))
q("agg37_cache", "SELECT count(*) AS repo_count, CAST(sum(s) AS BIGINT) AS total_size_bytes, sum(s) * 100.0::DOUBLE / 1000 AS usage_percent FROM (SELECT url, sum(level) AS s FROM incidents GROUP BY url)")(lambda d: Q.cache_stats(_cache(d), d.select((c("level") > 0).alias("hit")), 1000).select("repo_count", "total_size_bytes", "usage_percent"))
q("agg38_status", f", a AS ({_QUOTA}) SELECT left(CAST(token AS VARCHAR), 12) || '...' AS token, token % 7 = 0 AS is_blocked, count(DISTINCT resource) AS n FROM a GROUP BY 1, 2", _by_table("events"))(
    lambda d: Q.status_report(Q.quotas(_answers(d)).withColumn("blocked_until", F.when(c("token") % 7 == 0, F.lit(10**9))).withColumn("consecutive_errors", F.lit(0)).withColumn("token", c("token").cast("string")), F.lit(2000)).select("token", "is_blocked", F.size("resources").cast("long").alias("n"))
)

# captured pages: customers as the nodes of answers, ten a page


def _pages(t, node, wrap):
    rows = t[0].join(t[1], c("c_nationkey") == c("n_nationkey")).groupBy(F.floor(c("c_custkey") / 10).alias("at")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return rows.select("at", F.parse_json(F.to_json(wrap(c("nodes")))).alias("page"))


_st = F.struct
_owner = lambda: _st(F.lower("n_name").alias("login"))
_wrap = lambda n: _st(_st(_st(n.alias("nodes")).alias("search")).alias("data"))


def _repo_node():
    topics = _st(F.array(_st(_st(F.lower("c_mktsegment").alias("name")).alias("topic")), _st(F.lit(None).cast("struct<name: string>").alias("topic"))).alias("nodes"))
    branch = F.when(c("c_custkey") % 2 == 0, _st(_st(_st(c("c_custkey").alias("totalCount")).alias("history")).alias("target")))
    langs = _st(F.array(_st(_st(F.lit("SQL").alias("name")).alias("node"), c("c_custkey").alias("size"))).alias("edges"))
    return _st(c("c_name").alias("name"), _owner().alias("owner"), F.concat(F.lit("https://github.com/"), F.lower("n_name"), F.lit("/"), c("c_name")).alias("url"), c("c_nationkey").alias("stargazerCount"), (c("c_custkey") % 90).alias("diskUsage"), F.lit("2024-03-01T10:20:30Z").alias("createdAt"), F.when(c("c_custkey") % 3 > 0, c("c_mktsegment")).alias("description"), F.lit(True).alias("hasIssuesEnabled"), topics.alias("repositoryTopics"), branch.alias("defaultBranchRef"), langs.alias("languages"))


_cust = tables("customer", "nation")
q("prj01_repo_nodes", "SELECT lower(n_name) || '/' || c_name AS full_name, c_nationkey AS stargazers_count, CAST(c_custkey % 90 AS INT) AS size, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INT) ELSE 0 END AS commit_count, lower(c_mktsegment) AS topics, true AS has_issues, false AS private, c_custkey AS sql_bytes FROM customer JOIN nation ON c_nationkey = n_nationkey", _cust)(
    lambda t: G.graphql_repos(_pages(t, _repo_node(), _wrap), None).select("full_name", "stargazers_count", "size", "commit_count", F.array_join("topics", ",").alias("topics"), "has_issues", "private", c("languages")["SQL"].alias("sql_bytes"))
)
q("prj04_stats_row", "SELECT lower(n_name) || '/' || c_name AS full_name, CAST(c_custkey % 90 AS INT) AS size, lower(c_mktsegment) AS topics, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '_' END AS description, 1 AS has_issues, TIMESTAMP '2024-03-01 10:20:30' AS created_at FROM customer JOIN nation ON c_nationkey = n_nationkey", _cust)(
    lambda t: G.stats_row(G.graphql_repos(_pages(t, _repo_node(), _wrap), None)).select("full_name", "size", "topics", "description", "has_issues", "created_at")
)
q("prj02_code_nodes", "SELECT 'src/' || c_name || '.py' AS path, c_name || '.py' AS name, 'https://github.com/x/blob/master/src/' || c_name || '.py' AS html_url, lower(n_name) || '/r' AS full_name, CAST(c_custkey % 2 AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey", _cust)(
    lambda t: G.graphql_code(_pages(t, _st(F.concat(F.lit("src/"), c("c_name"), F.lit(".py")).alias("path"), F.when(c("c_custkey") % 2 == 1, "some text").alias("text"), _st(F.lit("r").alias("name"), F.lit("https://github.com/x").alias("url"), _owner().alias("owner")).alias("repository")), _wrap), None).select("path", "name", "html_url", "repository.full_name", F.size("fragments").cast("long").alias("n"))
)
q("src18_rest_stats", "SELECT c_custkey AS at, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(c_custkey % 4 AS INT) END AS size, CASE WHEN c_custkey % 7 = 0 THEN 'not found' WHEN c_custkey % 4 = 0 THEN 'size 0' END AS reason, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END AS stargazers_count FROM customer", _by_table("customer"))(
    lambda d: G.rest_stats(d.select(c("c_custkey").alias("at"), F.parse_json(F.when(c("c_custkey") % 7 == 0, '{"message": "Not Found", "status": "404"}').otherwise(F.to_json(_st(c("c_name").alias("full_name"), (c("c_custkey") % 4).alias("size"), c("c_nationkey").alias("stargazers_count"))))).alias("page"))).select("at", "size", "reason", "stargazers_count")
)
q("src17_gists", "SELECT c_name AS description FROM customer WHERE c_custkey % 5 = 0 OR c_mktsegment = 'BUILDING'", _cust)(
    lambda t: G.gists(_pages(t, _st(c("c_name").alias("description"), F.when(c("c_custkey") % 5 == 0, "Key.TXT building").otherwise(c("c_mktsegment")).alias("file")), lambda n: F.transform(n, lambda x: _st(x["description"].alias("description"), F.map_from_arrays(F.array(x["file"]), F.array(F.lit(1))).alias("files")))), "building").select("description")
)
q("src15_full_stats", "SELECT c_nationkey AS at, count(*) AS commits, count(DISTINCT c_mktsegment) AS authors, c_nationkey % 5 > 0 AS found FROM customer WHERE c_nationkey % 5 > 0 GROUP BY c_nationkey UNION ALL SELECT DISTINCT c_nationkey, 0, 0, false FROM customer WHERE c_nationkey % 5 = 0", _by_table("customer"))(
    lambda d: G.full_stats(
        # as the interface answers: many pages of a repository, about PAGE commits each, with the number of all
        d.join(d.groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey").groupBy(c("c_nationkey").alias("at"), "n", F.pmod(F.xxhash64("c_custkey"), F.ceil(c("n") / G.PAGE)).alias("nth")).agg(F.collect_list(_st(_st(c("c_mktsegment").alias("email"), c("c_name").alias("name")).alias("author"))).alias("nodes"))
        .select("at", F.parse_json(F.to_json(_st(_st(F.when(c("at") % 5 > 0, _st(_st(_st(_st(c("n").alias("totalCount"), "nodes").alias("history")).alias("target")).alias("defaultBranchRef"))).alias("repository")).alias("data")), {"ignoreNullFields": "false"})).alias("page"))
    ).select("at", "commits_count", F.explode_outer("commit_authors.email").alias("email"), "found")
    .groupBy("at").agg(F.max("commits_count").cast("long").alias("commits"), F.countDistinct("email").alias("authors"), F.bool_or("found").alias("found"))
)
q("src19_contributors", "SELECT c_nationkey AS at, c_mktsegment AS account, count(*) AS n FROM customer GROUP BY ALL", _by_table("customer"))(
    lambda d: G.contributors(d.groupBy(c("c_nationkey").alias("at"), c("c_mktsegment").alias("login")).agg(F.count("*").alias("contributions")).groupBy("at").agg(F.collect_list(_st("login", "contributions")).alias("x")).select("at", F.parse_json(F.to_json("x")).alias("page"))).select("at", "account", c("contributions").cast("long").alias("n"))
)
q("src16_fallback", "SELECT n_nationkey AS query, n_name AS r FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'rest' FROM nation WHERE n_nationkey % 2 = 1", _by_table("nation"))(lambda d: G.with_fallback(d.where("n_nationkey % 2 = 0").select(c("n_nationkey").alias("query"), c("n_name").alias("r")), d.select(c("n_nationkey").alias("query"), F.lit("rest").alias("r"))))
q("flt11_pushed", "SELECT id, 'pushed:' || strftime(found_at::DATE - 30, '%Y-%m-%d') || '..' || strftime(found_at, '%Y-%m-%d') AS q FROM incidents")(lambda d: d.select("id", G.pushed_between(F.to_date("found_at"), 30).alias("q")))
q("dat01_stamp", "SELECT id, CASE WHEN id % 2 = 0 THEN date_trunc('second', found_at) END AS t FROM incidents")(lambda d: d.select("id", G.stamp(F.when(c("id") % 2 == 0, F.date_format("found_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")).alias("t")))
q("prj07_candidates", "SELECT id, 'Code' AS obj_type, 'https://github.com/org' || company_id || '/repo' || (id % 97) AS repo_url, 'org' || company_id || '/repo' || (id % 97) AS repo_name, 'org' || company_id AS author_name FROM incidents")(
    lambda d: d.select("id", G.candidate("Code", F.concat(F.lit("https://github.com/org"), c("company_id"), F.lit("/repo"), c("id") % 97, F.lit("/blob/x.py")), F.lit("d"), F.lit(None).cast("string"), c("company_id")).alias("r")).select("id", "r.obj_type", "r.repo_url", "r.repo_name", "r.author_name")
)
q("j05_fallback_names", "SELECT id, CASE WHEN id % 9 = 0 THEN 'own' ELSE coalesce(s_name, CASE company_id WHEN 1 THEN 'vtb' WHEN 2 THEN 'inno' WHEN 3 THEN 't1' END, 'company_' || company_id) END AS name FROM incidents LEFT JOIN supplier ON s_suppkey = company_id AND s_suppkey <> 2 AND s_suppkey <> 3", tables("incidents", "supplier"))(
    lambda t: t[0].join(t[1].where("s_suppkey not in (2, 3)"), c("s_suppkey") == c("company_id"), "left").select("id", O.company_name(c("s_name"), F.when(c("id") % 9 == 0, "own").otherwise(c("company_id").cast("string"))).alias("name"))
)
q("src03_url_ids", "SELECT url, max_by(result, id) AS result, max(id) AS id FROM incidents WHERE level > 0 GROUP BY url")(lambda d: D.latest(d.where("level > 0").select("url", "result", "id"), "url", "id"))
q("j08_account_names", "SELECT o_custkey AS leak_id, list_sort(list_distinct(list(o_orderpriority))) AS names FROM orders GROUP BY 1", _by_table("orders"))(lambda d: O.account_names(d.select(c("o_custkey").alias("leak_id"), c("o_orderkey").alias("account_id")), d.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("account"))))
q("j15_lines_of", "SELECT f.file, f.seq AS line_no, length(r.text) AS n FROM findings f LEFT JOIN repo_lines r ON r.file = f.file AND r.line_no = f.seq WHERE f.rule = 'email'", tables("findings", "repo_lines"))(lambda t: O.lines_of(t[0].where("rule = 'email'").select("file", c("seq").alias("line_no")), t[1]).select("file", "line_no", F.length("text").alias("n")))
q("src12_rest_pages", "SELECT 'https://github.com/' || c_name AS url, 'o/' || c_name AS full_name, 'o' AS author_name, CAST(c_custkey % 90 AS INT) AS size FROM customer WHERE c_custkey // 10 % 4 <> 3", _cust)(
    lambda t: G.rest_repos(_pages(t, _st(F.concat(F.lit("https://github.com/"), c("c_name")).alias("html_url"), F.concat(F.lit("o/"), c("c_name")).alias("full_name"), _st(F.lit("o").alias("login")).alias("owner"), (c("c_custkey") % 90).alias("size")), lambda n: _st(n.alias("items"), F.when(c("at") % 4 == 3, "rate limit").alias("message"))))
)
q("src20_commits", "SELECT repo, seq, name, email FROM (SELECT c_nationkey AS repo, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seq, c_name AS name, lower(c_name) AS email FROM customer)", _by_table("customer"))(
    lambda d: committers_first_seen(G.commits(d.groupBy(c("c_nationkey").alias("at")).agg(F.array_sort(F.collect_list(_st("c_custkey", _st(_st(c("c_name").alias("name"), F.lower("c_name").alias("email")).alias("author")).alias("commit")))).alias("x")).select("at", F.parse_json(F.to_json("x")).alias("page"))).withColumn("seq", c("seq").cast("long")))
)
q("str22_addresses", "SELECT id, regexp_matches(u, '^https?://(gist\\.)?github\\.com/[^/]+/.+') AS listed, regexp_matches(u, '^https?://([^/?#]+\\.)?github\\.com([/?#]|$)') AS hosted FROM (SELECT id, ['https://github.com/', 'http://gist.github.com/', 'https://z.github.com/', 'ftp://github.com/', 'https://gitlab.com/'][CAST(id % 5 AS INT) + 1] || ['a', 'a/b', 'a/b/c', ''][CAST(id // 5 % 4 AS INT) + 1] AS u FROM incidents)")(
    lambda d: d.withColumn("u", F.concat(V._pick(("https://github.com/", "http://gist.github.com/", "https://z.github.com/", "ftp://github.com/", "https://gitlab.com/"), "id % 5"), V._pick(("a", "a/b", "a/b/c", ""), "floor(id / 5) % 4"))).select("id", P.valid_listed_url(c("u")).alias("listed"), P.valid_repo_host(c("u")).alias("hosted"))
)
