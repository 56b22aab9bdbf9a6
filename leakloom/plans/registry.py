"""name -> query over the driver tables, and name -> oracle SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import text as T
from leakloom.operators import ranking as N
from leakloom.operators import reports as R
from leakloom.operators import scoring as S
from leakloom.operators import store as O
from leakloom.operators import tables as D
from leakloom.operators.people import committers_first_seen
from leakloom.sources import lists as L
from leakloom.streaming import ingest as I

from . import views as V
from .catalog import ORACLE_SQL, QUERIES, c, q, tables

# scans
q("src01_equality_scan", "SELECT id, url, level FROM incidents WHERE level = 2 ORDER BY id LIMIT 100 OFFSET 10")(lambda d: D.scan(d.select("id", "url", "level"), {"level": 2}, 100, 10))
q("src02_period_scan", "SELECT * FROM incidents WHERE found_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")(lambda d: R.in_period(d, "2024-01-05", "2024-01-20"))
q("src03_latest_by_url", "SELECT url, max_by(result, id) AS result, max(id) AS id FROM incidents GROUP BY url")(lambda d: D.latest(d.select("url", "result", "id"), "url", "id"))
q("src04_status_scan", "SELECT id, url FROM incidents WHERE result = 5")(lambda d: O.with_status(d, 5).select("id", "url"))
q("src05_point_lookup", "SELECT id FROM incidents WHERE url = 'https://github.com/org0/repo0' ORDER BY id LIMIT 1")(lambda d: O.id_of(d, "https://github.com/org0/repo0"))
q("src06_terms_decoded", "SELECT id % 50 AS company_id, unnest(string_split(url || ', ' || leak_type, ', ')) AS term FROM incidents")(lambda d: d.select((c("id") % 50).alias("company_id"), F.base64(F.encode(F.concat_ws(", ", "url", "leak_type"), "UTF-8")).alias("dork")).select("company_id", F.explode(F.split(F.decode(F.unbase64("dork"), "UTF-8"), ", ")).alias("term")))
q("src21_file_lines", "SELECT repo, file, line_no, length(text) AS n FROM repo_lines WHERE length(trim(text)) BETWEEN 1 AND 1000", V.repo_lines)(lambda d: d.where(F.length(F.trim("text")).between(1, 1000)).select("repo", "file", "line_no", F.length("text").alias("n")))

# projections and filters
q("prj03_leak_row", "SELECT id, CASE WHEN length(text) > 10000 THEN left(text, 10000) || '...' ELSE text END AS leak_type, length(text) AS n FROM (SELECT doc_id AS id, text FROM documents)", lambda s, d: V.table(s, d, "documents"))(lambda d: d.select(c("doc_id").alias("id"), T.truncated(c("text"), 10000).alias("leak_type"), F.length("text").alias("n")))
q("flt02_deepscan_candidates", "SELECT id, url FROM incidents WHERE result = 5 AND url LIKE 'https://github.com/%'")(lambda d: d.where((c("result") == 5) & P.valid_repo_host(c("url"))).select("id", "url"))
q("flt03_rescan_candidates", "SELECT id, url FROM incidents WHERE result = 4 AND url LIKE 'https://github.com/%'")(lambda d: d.where((c("result") == 4) & P.valid_repo_host(c("url"))).select("id", "url"))
q("flt05_size_gate", "SELECT p_partkey, p_size FROM part WHERE p_size <= 30", lambda s, d: V.table(s, d, "part"))(lambda d: O.small_enough(d.select("p_partkey", c("p_size").alias("size")), 30).select("p_partkey", c("size").alias("p_size")))
q("flt12_serious", "SELECT id, level FROM incidents WHERE level >= 2")(lambda d: R.serious(d).select("id", "level"))

# joins
q("j01_anti_known", "SELECT id, url FROM incidents a WHERE NOT EXISTS (SELECT 1 FROM incidents b WHERE b.level = 3 AND b.url = a.url)")(lambda d: D.unseen(d.select("id", "url"), d.where("level = 3"), "url"))
q("j02_anti_excluded", "SELECT id, url FROM incidents WHERE NOT regexp_matches(url, '^https://[a-z.]+/org(1|2|3)/.*$')")(lambda d: d.where(~c("url").rlike("^https://[a-z.]+/org(1|2|3)/.*$")).select("id", "url"))
q("j03_semi_stats", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", tables("lineitem", "orders"))(lambda t: O.of_leaks(t[0].select("l_orderkey", "l_linenumber"), t[1].where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id")), "l_orderkey"))
q("j05_company_name", "SELECT id, coalesce(s_name, CASE company_id WHEN 1 THEN 'first' END, 'company_' || company_id) AS name FROM incidents LEFT JOIN supplier ON s_suppkey = company_id AND s_suppkey > 5", tables("incidents", "supplier"))(lambda t: t[0].join(t[1].where("s_suppkey > 5"), c("s_suppkey") == c("company_id"), "left").select("id", F.coalesce("s_name", F.when(c("company_id") == 1, "first"), F.concat(F.lit("company_"), "company_id")).alias("name")))
q("j06_company_of_leak", "SELECT o_orderkey, coalesce(company_id, 1) AS company_id FROM orders LEFT JOIN incidents ON id = o_orderkey", tables("orders", "incidents"))(lambda t: O.company_of(t[0].select("o_orderkey"), t[1], "o_orderkey").select("o_orderkey", "company_id"))
q("j08_bridge", "SELECT o_custkey, list_sort(list_distinct(list(n_name))) AS names FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY o_custkey", tables("orders", "customer", "nation"))(lambda t: t[0].join(t[1], c("o_custkey") == c("c_custkey")).join(t[2], c("c_nationkey") == c("n_nationkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("n_name")).alias("names")))
q("j09_term_product", "SELECT DISTINCT n_name || ' ' || r_name AS term FROM nation, region WHERE n_nationkey >= 3", tables("nation", "region"))(lambda t: L.products(t[0].where("n_nationkey >= 3").select(c("n_name").alias("term")), t[1].select(c("r_name").alias("term"))))
q("j10_token_in_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'une')", lambda s, d: V.table(s, d, "documents"))(lambda d: d.where(F.exists(F.array(F.lit("the"), F.lit("une")), lambda t: F.contains(F.lower("text"), t))).select("doc_id"))
q("j13_upsert", "SELECT id, max_by(level, src) AS level, max_by(result, src) AS result FROM (SELECT id, level, result, 0 AS src FROM incidents WHERE id % 3 > 0 UNION ALL SELECT id, level + 1, result, 1 FROM incidents WHERE id % 2 = 0) GROUP BY id")(lambda d: D.upsert(d.where("id % 3 > 0").select("id", "level", "result"), d.where("id % 2 = 0").select("id", (c("level") + 1).alias("level"), "result"), "id", ["level", "result"]))
q("j15_line_lookup", "SELECT f.file, r.line_no, length(r.text) AS n FROM (SELECT DISTINCT file FROM findings WHERE rule = 'licence') f JOIN repo_lines r ON r.file = f.file AND r.line_no = 0", tables("findings", "repo_lines"))(lambda t: t[0].where("rule = 'licence'").select("file").distinct().join(t[1].where("line_no = 0"), "file").select("file", "line_no", F.length("text").alias("n")))

# aggregates
q("agg01_count", "SELECT count(*) AS cnt FROM incidents")(R.total)
q("agg02_by_result", "SELECT CAST(result AS VARCHAR) AS result, count(*) AS cnt FROM incidents GROUP BY 1")(R.by_status)
q("agg03_top_types", "SELECT leak_type, count(*) AS cnt FROM incidents GROUP BY 1 ORDER BY cnt DESC, leak_type LIMIT 3")(lambda d: R.top_types(d, 3))
q("agg04_by_level", "SELECT level, count(*) AS cnt FROM incidents GROUP BY 1")(lambda d: R.counts_by(d, "level"))
q("agg05_avg_level", "SELECT coalesce(avg(level), 0.0) AS avg_level FROM incidents")(R.average_level)
q("agg06_distinct_companies", "SELECT count(DISTINCT CASE WHEN company_id <> 0 THEN company_id END) AS n FROM incidents")(R.distinct_companies)
q("agg07_distinct_urls", "SELECT count(DISTINCT url) AS n FROM incidents")(R.distinct_urls)
q("agg08_daily", "SELECT CAST(found_at AS DATE) AS day, count(*) AS cnt FROM incidents GROUP BY 1")(R.daily)
q("agg10_basic_stats", "SELECT count(*) AS total, coalesce(avg(level), 0.0) AS avg_level, count(*) FILTER (level >= 2) AS serious, count(*) FILTER (level >= 3) AS critical, count(DISTINCT CASE WHEN company_id <> 0 THEN company_id END) AS companies, count(DISTINCT url) AS urls FROM incidents")(R.basic_stats)
q("agg12_peak_hour", "SELECT CAST(h AS INTEGER) AS peak_hour FROM (SELECT hour(found_at) AS h, count(*) AS c FROM incidents GROUP BY 1) ORDER BY c DESC, h LIMIT 1")(R.peak_hour)
_CATEGORY = "CASE WHEN regexp_matches(upper(leak_type), 'API|KEY') THEN 'API Keys' WHEN regexp_matches(upper(leak_type), 'DATABASE|DB{}') THEN 'Database Credentials' WHEN regexp_matches(upper(leak_type), 'PRIVATE|RSA{}') THEN 'Private Keys' WHEN regexp_matches(upper(leak_type), 'DEBUG|LOG') THEN 'Debug Information' ELSE 'Other' END"
q("agg14_category_breakdown", f"SELECT {_CATEGORY.format('|SQL', '|SSH')} AS category, count(*) AS incidents, round(avg(level), 1) AS avg_level, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percentage FROM incidents GROUP BY 1")(R.category_breakdown)
q("agg15_company_breakdown", "SELECT company_id, count(*) AS total, count(*) FILTER (result = 1) AS resolved, count(*) FILTER (result = 0) AS pending FROM incidents WHERE company_id <> 0 GROUP BY 1 ORDER BY total DESC, company_id LIMIT 10")(R.company_breakdown)
_PLATFORM = "CASE WHEN contains(url, 'github.com') THEN 'GitHub' WHEN contains(url, 'gitlab.com') THEN 'GitLab' WHEN contains(url, 'bitbucket.org') THEN 'Bitbucket' ELSE 'Other' END"
q("agg17_platforms", f"SELECT {_PLATFORM} AS platform, count(DISTINCT url) AS repos, count(*) AS leaks FROM incidents GROUP BY 1")(R.platform_breakdown)
q("agg18_risk_score", "SELECT round(avg(CASE level WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 10 ELSE 0 END), 1) AS risk FROM incidents")(R.risk_score)
q("agg20_monthly", "SELECT strftime(found_at, '%Y-%m') AS month, count(*) AS incidents, count(*) FILTER (result = 1) AS resolved, CAST(round(count(*) FILTER (result = 1) * 100.0::DOUBLE / count(*)) AS INTEGER) AS efficiency FROM incidents GROUP BY 1 ORDER BY month DESC LIMIT 12")(R.monthly_trends)
q("agg21_scanner_metrics", "SELECT count(*) AS total, count(DISTINCT url) AS unique_urls, greatest(1, count(*) // 20) AS false_positives FROM incidents")(R.scanner_metrics)
q("agg22_technical_types", f"SELECT {_CATEGORY.format('', '')} AS category, count(*) AS cnt, round(avg((level + 1) * 25.0::DOUBLE), 1) AS severity FROM incidents GROUP BY 1")(R.technical_types)
q("agg23_risky_repos", "SELECT url, string_split(url, '/')[-1] AS name, count(*) AS issues, max(level) AS max_level, CASE WHEN max(level) >= 3 THEN 'critical' WHEN max(level) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM incidents GROUP BY url ORDER BY issues DESC, max_level DESC, url LIMIT 5")(R.risky_repos)
q("agg24_stats_summary", "SELECT count(*) AS n, round(coalesce(avg(l_quantity), 0), 6) AS avg_size FROM lineitem WHERE l_orderkey IN (SELECT id FROM incidents WHERE level >= 2)", tables("lineitem", "incidents"))(lambda t: t[0].join(t[1].where("level >= 2"), c("l_orderkey") == c("id"), "left_semi").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("l_quantity"), F.lit(0.0)), 6).alias("avg_size")))
_PUBLIC = "list_contains(['gmail.com','yahoo.com','hotmail.com','outlook.com','live.com','yandex.ru','mail.ru','rambler.ru','bk.ru','list.ru','protonmail.com','tutanota.com','github.com','gitlab.com'], string_split(email, '@')[-1]) OR regexp_matches(email, '@.*(noreply|no-reply|no_reply|mailer-daemon|donotreply)')"
q("agg26_committers", f"SELECT repo, bool_or(NOT ({_PUBLIC})) AS corporate, bool_and({_PUBLIC}) AS all_public, count(DISTINCT (name, email)) AS people FROM committers GROUP BY repo", V.committers)(R.committer_analysis)
q("agg30_entropy", "SELECT repo, file, rule, seq, round(list_aggregate(string_split(match, ''), 'entropy'), 6) AS bits FROM findings", V.findings)(lambda d: d.select("repo", "file", "rule", "seq", F.round(T.entropy(c("match")), 6).alias("bits")))
q("agg32_scanner_hits", "SELECT repo, rule, count(*) AS hits FROM findings GROUP BY ALL", V.findings)(lambda d: d.groupBy("repo", "rule").agg(F.count("*").alias("hits")))
q("agg33_scan_metrics", "SELECT count(*) FILTER (toxic = 1) AS found, count(*) FILTER (toxic = 1 AND quality = 1) AS real, round(count(*) FILTER (toxic = 1 AND quality = 1) / greatest(1, count(*) FILTER (toxic = 1)), 6) AS precision, round(count(*) FILTER (toxic = 1) / greatest(1, count(*)), 6) AS rate FROM labels", lambda s, d: V.table(s, d, "labels"))(R.scan_metrics)
q("agg34_by_outcome", "SELECT rule, CASE WHEN file % 5 IN (1, 4) THEN 'real' WHEN file % 5 = 0 THEN 'false' ELSE 'review' END AS outcome, count(*) AS cnt FROM findings GROUP BY ALL", V.findings)(lambda d: d.groupBy("rule", F.when((c("file") % 5).isin(1, 4), "real").when(c("file") % 5 == 0, "false").otherwise("review").alias("outcome")).agg(F.count("*").alias("cnt")))
q("agg35_contributors_merged", "SELECT repo, greatest(count(*), len(list_distinct(list(email)))) AS contributors FROM committers GROUP BY repo", V.committers)(lambda d: d.groupBy("repo").agg(F.greatest(F.count("*"), F.countDistinct("email")).alias("contributors")))
q("agg39_accent_density", "SELECT doc_id, round(length(regexp_replace(text, '[^À-ÿ]', '', 'g')) / greatest(length(text), 1), 6) AS density FROM documents", lambda s, d: V.table(s, d, "documents"))(lambda d: d.select("doc_id", F.round(F.length(F.regexp_replace("text", "[^À-ÿ]", "")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("density")))
q("rpt_template_metrics", "SELECT round(count(*) FILTER (result = 1) * 100.0::DOUBLE / count(*), 1) AS accuracy, greatest(1, count(*) FILTER (level >= 3) // 5) AS violations, greatest(1, count(*) // 6) AS high, greatest(1, count(*) // 4) AS medium, greatest(1, count(*) // 3) AS low, round(count(*) / greatest(count(DISTINCT url), 1), 1) AS leaks_per_repo FROM incidents")(R.template_metrics)

# windows, order, dedup
_by = ["repo", "rule"]
q("win01_numbering", "SELECT repo, file, rule, seq, row_number() OVER (PARTITION BY repo, rule ORDER BY file, seq) - 1 AS leak_no FROM findings", V.findings)(lambda d: N.numbered(d, _by, ["file", "seq"]).drop("match"))
q("win03_cap_per_scanner", "SELECT repo, file, rule, seq FROM findings QUALIFY row_number() OVER (PARTITION BY repo, rule ORDER BY file, seq) <= 200", V.findings)(lambda d: N.capped(d, _by, ["file", "seq"], 200).drop("match"))
q("win08_first_line", "SELECT repo, min_by(match, lpad(CAST(file AS VARCHAR), 20, '0') || lpad(CAST(seq AS VARCHAR), 9, '0') || rule) AS match FROM findings GROUP BY repo", V.findings)(lambda d: R.first_matches(d, ["file", "seq", "rule"]))
q("win09_share", "SELECT level, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM incidents GROUP BY level")(R.level_shares)
q("srt04_top_leaks", "SELECT id, level, found_at FROM incidents ORDER BY level DESC, found_at DESC, id LIMIT 10")(lambda d: R.top_leaks(d).select("id", "level", "found_at"))
q("set01_union", "SELECT rule, match FROM findings WHERE rule = 'email' UNION ALL SELECT rule, match FROM findings WHERE rule = 'ipv4'", V.findings)(lambda d: d.where("rule = 'email'").select("rule", "match").unionByName(d.where("rule = 'ipv4'").select("rule", "match")))
q("set05_except", "SELECT url FROM incidents WHERE level > 0 EXCEPT SELECT url FROM incidents WHERE level = 0")(lambda d: d.where("level > 0").select("url").subtract(d.where("level = 0").select("url")))
q("ded01_lines", "SELECT file, line_no FROM repo_lines QUALIFY row_number() OVER (PARTITION BY file, lower(trim(text)) ORDER BY line_no) = 1", V.repo_lines)(lambda d: D.first_seen(d, ["file", F.lower(F.trim("text"))], ["line_no"]).select("file", "line_no"))
q("ded02_match_file", "SELECT repo, file, rule, min(seq) AS seq, match FROM findings GROUP BY ALL", V.findings)(lambda d: d.groupBy("repo", "file", "rule", "match").agg(F.min("seq").alias("seq")))
_RANK = "CASE rule WHEN 'assign' THEN 0 WHEN 'email' THEN 1 WHEN 'ipv4' THEN 2 ELSE 3 END"
q("ded03_unified", f"SELECT repo, file, rule, seq FROM findings QUALIFY row_number() OVER (PARTITION BY repo, left(lower(match), 50) ORDER BY {_RANK}, file, seq) = 1", V.findings)(lambda d: D.first_seen(d.withColumn("rank", F.expr(_RANK)), ["repo", F.left(F.lower("match"), F.lit(50))], ["rank", "file", "seq"]).select("repo", "file", "rule", "seq"))
q("ded06_by_email", "SELECT email, min(id) AS id FROM committers GROUP BY email", V.committers)(lambda d: d.groupBy("email").agg(F.min("id").alias("id")))

# strings, paths, scores
docs = lambda s, d: V.table(s, d, "documents")
q("str01_repetitive", "SELECT rule, seq, file, length(match) >= 6 AND (regexp_matches(match, '(?s)(' || array_to_string(list_transform(range(48, 58), lambda i: chr(CAST(i AS INT)) || '{3}.'), '|') || '|[.]{3}.)') OR len(list_filter(range(3, CAST(least(length(match) // 2 + 1, 20) AS BIGINT)), lambda k: match = left(repeat(left(match, k), CAST(ceil(length(match) / k) AS BIGINT)), length(match)))) > 0) AS rep FROM findings WHERE rule = 'ipv4'", V.findings)(lambda d: d.where("rule = 'ipv4'").select("rule", "seq", "file", (T.has_repetitive_pattern(c("match"))).alias("rep")))
q("str04_placeholder", "SELECT doc_id, lang || '_here' AS w, true AS p FROM documents", docs)(lambda d: d.select("doc_id", F.concat("lang", F.lit("_here")).alias("w"), T.is_known_placeholder(F.concat("lang", F.lit("_here"))).alias("p")))
q("str10_context", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN position('license' IN lower(text)) > 0 THEN (CASE WHEN position('license' IN lower(text)) > 51 THEN '...' ELSE '' END) || substr(text, greatest(position('license' IN lower(text)) - 50, 1), least(position('license' IN lower(text)) + 57, length(text) + 1) - greatest(position('license' IN lower(text)) - 50, 1)) || (CASE WHEN position('license' IN lower(text)) + 57 <= length(text) THEN '...' ELSE '' END) ELSE left(text, 100) || '...' END AS ctx FROM documents", docs)(lambda d: d.select("doc_id", T.context_around(c("text"), F.lit("license")).alias("ctx")))
q("str13_search_terms", "SELECT file, line_no, regexp_extract(text, '(?i)\\b(?:license|licensed|version)\\b', 0) AS hit FROM repo_lines WHERE regexp_matches(text, '(?i)\\b(?:license|licensed|version)\\b')", V.repo_lines)(lambda d: d.where(c("text").rlike(r"(?i)\b(?:license|licensed|version)\b")).select("file", "line_no", F.regexp_extract("text", r"(?i)\b(?:license|licensed|version)\b", 0).alias("hit")))
q("str15_path_parts", "SELECT page_id, regexp_matches(lower(url), '[/\\\\](test|docs|lib|tmp|guide)[/\\\\.]|[/\\\\](test|docs|lib|tmp|guide)$') AS hit FROM pages", V.urls)(lambda d: d.select("page_id", P.matches_parts(c("url"), ["test", "docs", "lib", "tmp", "guide", "zzzzzzzz"]).alias("hit")))
q("str21_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages", V.urls)(lambda d: d.select("page_id", P.host(c("url")).alias("host")))
q("str23_normalised", "SELECT id, 'https://github.com/' || array_to_string(string_split(string_split(url, 'github.com/')[-1], '/')[1:2], '/') AS repo FROM incidents WHERE contains(url, 'github.com')")(lambda d: d.where(c("url").contains("github.com")).select("id", P.normalised_repo(c("url")).alias("repo")))
q("str24_company", "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[ ./]', '-', 'g'), '[()]', '', 'g') AS name FROM supplier", lambda s, d: V.table(s, d, "supplier"))(lambda d: d.select("s_suppkey", T.sanitized_company(c("s_name")).alias("name")))
q("str28_domain", "SELECT id, lower(trim(string_split(email, '@')[-1])) AS domain FROM committers", V.committers)(lambda d: d.select("id", P.email_domain(c("email")).alias("domain")))
q("str32_masked", "SELECT repo, file, rule, seq, CASE WHEN length(match) > 8 THEN left(match, 4) || repeat('*', length(match) - 8) || right(match, 4) ELSE repeat('*', length(match)) END AS shown FROM findings", V.findings)(lambda d: d.select("repo", "file", "rule", "seq", T.masked(c("match")).alias("shown")))
q("cls18_level", "SELECT p_partkey, CASE WHEN p_size / 50 >= 0.7 THEN 2 WHEN p_size / 50 >= 0.5 THEN 1 ELSE 0 END AS level FROM part", lambda s, d: V.table(s, d, "part"))(lambda d: d.select("p_partkey", S.leak_level(c("p_size") / 50).alias("level")))
q("cls01_secret_class", None, V.findings)(lambda d: d.select("repo", "file", "rule", "seq", S.secret_class(c("rule"), c("match"), F.lit("src/app.py")).alias("k")).select("repo", "file", "rule", "seq", "k.type", "k.weight"))
q("cls04_validity", None, V.findings)(lambda d: d.select("repo", "file", "rule", "seq", F.round(S.validity(c("match"), F.lit("src/app.py"), S.secret_class(c("rule"), c("match"), F.lit("src/app.py"))["type"], F.lit(0.5)), 6).alias("validity")))
q("sco03_path_relevance", "SELECT id, round(CAST(CASE WHEN contains(url, 'example') THEN 0 ELSE least(1, (CASE WHEN contains(url, '/org3/') THEN CASE WHEN contains(url, '.com/') THEN 1.2 ELSE 0.7 END ELSE 0 END) + (CASE WHEN url LIKE '%/repo1' THEN 0.7 WHEN contains(url, '/repo1') THEN 0.5 ELSE 0 END)) END AS DOUBLE), 6) AS score FROM incidents")(lambda d: d.select("id", F.round(S.path_relevance(F.array(F.concat("url", F.lit("/config/app.properties"))), ["org3", "repo1"]), 6).alias("score")))
_TP = "greatest(org * 0.5 + sens * 0.5, CASE WHEN n > 0 AND org >= 0.15 THEN 0.5 ELSE 0 END, CASE WHEN n >= 5 AND org >= 0.15 THEN 0.6 ELSE 0 END, CASE WHEN n > 0 AND org < 0.15 THEN 0.15 ELSE 0 END, CASE WHEN n >= 10 AND org < 0.15 THEN 0.25 ELSE 0 END, CASE WHEN sens >= 0.7 AND org >= 0.1 THEN 0.55 ELSE 0 END, CASE WHEN sens >= 0.5 AND org >= 0.1 THEN 0.4 ELSE 0 END)"
q("sco07_profitability", f"SELECT l_orderkey, l_linenumber, round(least(1, {_TP}), 9) AS tp FROM (SELECT l_orderkey, l_linenumber, l_discount * 10::DOUBLE AS org, l_quantity / 64::DOUBLE AS sens, l_linenumber AS n FROM lineitem)", lambda s, d: V.table(s, d, "lineitem"))(lambda d: d.select("l_orderkey", "l_linenumber", S.profitability(c("l_discount") * 10, c("l_quantity") / 64, c("l_linenumber"), F.lit(False), digits=9).alias("tp")))
q("sco12_verdict", "SELECT l_orderkey, l_linenumber, CASE WHEN u <= 0.1 AND org < 0.1 OR u <= 0.2 AND f AND i THEN 0 WHEN u <= 0.2 AND (f OR i) THEN 5 ELSE 4 END AS result FROM (SELECT *, org < 0.05 AND sens <= 0.2 AS f, l_linenumber % 2 = 0 AS i FROM (SELECT l_orderkey, l_linenumber, l_discount * 2::DOUBLE AS u, l_tax * 4::DOUBLE AS org, l_quantity / 64::DOUBLE AS sens FROM lineitem))", lambda s, d: V.table(s, d, "lineitem"))(lambda d: d.select("l_orderkey", "l_linenumber", S.verdict(c("l_discount") * 2, c("l_tax") * 4, c("l_quantity") / 64, F.lit(0.5), F.lit(0.5), F.lit(0.5), c("l_linenumber") % 2 == 0, F.lit(False))["result"].alias("result")))

# store and streams (as batch)
q("snk09_reconciled", "SELECT id, CASE WHEN NOT contains(url, 'github.com') AND result = 1 THEN 3 WHEN NOT contains(url, 'github.com') AND result = 5 THEN 2 ELSE result END AS result FROM incidents")(lambda d: D.reconciled(d, d.where(c("url").contains("github.com"))).select("id", "result"))
q("snk08_coerced", "SELECT id, coalesce(TRY_CAST(leak_type AS INTEGER), 0) AS a, level AS b, lower(CAST(level AS VARCHAR)) IN ('true', '1', 'yes') AS flag FROM incidents")(lambda d: D.stats_coerced(d.select("id", c("leak_type").alias("a"), c("level").alias("b"), c("level").cast("string").alias("flag")), ["a", "b"], ["flag"]))
q("stm05_minute_counters", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL", lambda s, d: V.table(s, d, "events"))(lambda d: I.counters(d, "event_type"))
q("stm07_lifecycle", "SELECT url, max_by(result, id) AS status FROM incidents GROUP BY url")(lambda d: d.groupBy("url").agg(F.max_by("result", "id").alias("status")))
q("ded05_committers", None, V.committers)(lambda d: committers_first_seen(d.select(c("repo"), c("name"), c("email"), c("id").alias("seq"))))

# the rest registers itself
from . import analysis_queries, report_queries, scale_queries, store_queries, text_queries  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES"]
