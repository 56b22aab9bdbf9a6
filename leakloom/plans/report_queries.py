"""Queries of status texts in both languages, of benchmark reports, and of large captures, with oracle SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom import jobs
from leakloom.functions import documents as D
from leakloom.functions.messages import MESSAGES
from leakloom.functions.rules import SCANNERS
from leakloom.operators import benchmark as B
from leakloom.operators import html as H
from leakloom.operators import narrative as S
from leakloom.operators import reports as R
from leakloom.operators.cuts import shared_dir
from leakloom.sources import captures as C
from leakloom.sources import pages as G
from leakloom.sources import split_json as J
from leakloom.streaming import stages as T

from . import views as V
from .catalog import ORACLE_SQL, c, q, tables

# status texts

#: name -> SQL that both engines read, over candidates.
_FIELDS = {
    "unified_probability": "cast(repo % 11 as double) / 10", "credibility": "cast(repo % 8 as double) / 8", "is_tiny": "size < 60", "is_personal": "repo % 4 = 1", "is_very_popular": "repo % 5 = 2", "obj_type": "case when fork then 'Code' else 'Repositories' end",
    "dork": "dork", "description": "case when repo % 9 = 0 then '_' when repo % 9 = 1 then null else description end", "topics": "case when repo % 6 = 0 then '' else topics end",
    "first_line": "case when repo % 3 = 1 then concat('line ', cast(repo as varchar(9))) end", "report_length": "size * 10", "ai_related": "ai_related", "ai_confidence": "cast(ai_confidence as double)",
    "ai_level": "case when repo % 2 = 0 then 'high' else 'low' end", "ai_score": "cast(ai_severity as double)", "ai_summary": "case when repo % 7 = 0 then ' ' else concat(repo_name, repeat(' found', cast(repo % 50 as int))) end",
    "org_relevance": "cast(repo % 10 as double) / 10", "sensitive": "cast(repo % 5 as double) / 5",
}
_PEOPLE = "repo % 9"
_CORPORATE = "repo % 3"


def _status(d: DataFrame, lang: str) -> DataFrame:
    cols = {k: F.expr(v.replace("varchar(9)", "string")) for k, v in _FIELDS.items()}
    cols["committers"] = F.expr(f"transform(if({_PEOPLE} = 0, cast(array() as array<bigint>), sequence(1, {_PEOPLE})), i -> concat('p', i, '/p', i, '@x.org'))")
    cols["corporate"] = F.expr(f"transform(if({_CORPORATE} = 0, cast(array() as array<bigint>), sequence(1, {_CORPORATE})), i -> struct(concat('c', i) as name, concat('c', i, '@acme.com') as email, 'acme.com' as domain, i = 1 as matches_company))")
    cols["hits"] = F.create_map(*(x for i, s in enumerate(SCANNERS) for x in (F.lit(s), (c("repo") * (i + 3) % 4))))
    return d.select("repo", S.status(lambda k: cols[k], lang).alias("status"))


def _said(lang: str, key: str, **values: str) -> str:
    """A message as SQL: its texts and the SQL of its places, with two decimals where it says so."""
    parts = []
    for text, name, form in re.findall(r"([^{]+)|\{(\w+)(:\.2f)?\}", MESSAGES[lang][key]):
        parts.append("'" + text.replace("'", "''") + "'" if text else f"coalesce({f'format(chr(123) || chr(58) || chr(46) || chr(50) || chr(102) || chr(125), {values[name]})' if form else f'CAST({values[name]} AS VARCHAR)'}, '')")
    return "(" + " || ".join(parts) + ")"


def _status_sql(lang: str) -> str:
    m = lambda key, **v: _said(lang, key, **v)
    when = lambda cond, text: f"CASE WHEN {cond} THEN {text} END"
    cut = lambda t, n: f"CASE WHEN length({t}) > {n} THEN left({t}, {n}) || '...' ELSE {t} END"
    hits = [f"(repo * {i + 3} % 4)" for i in range(len(SCANNERS))]
    shown = "array_to_string(list_transform(range(1, least(repo % 9, 5) + 1), lambda i: 'p' || i || '/p' || i || '@x.org'), ', ')"
    head = f"CASE WHEN unified_probability >= 0.7 THEN {m('high_chance')} WHEN unified_probability >= 0.5 THEN {m('medium_chance')} WHEN unified_probability >= 0.2 THEN {m('low_chance')} ELSE {m('no_chance')} END"
    text = "coalesce(description, '')"
    tail = [
        f"CASE WHEN credibility >= 0.7 THEN {m('repo_credibility_high', score='credibility')} WHEN credibility >= 0.4 THEN {m('repo_credibility_medium', score='credibility')} ELSE {m('repo_credibility_low', score='credibility')} END",
        when("is_tiny", m("repo_is_tiny")),
        when("is_personal", m("repo_is_personal")),
        when("is_very_popular", m("repo_is_popular_oss")),
        m("leak_found_in_section", obj_type="obj_type", dork="dork"),
        f"CASE WHEN trim({text}) IN ('', '_') THEN {m('no_description')} ELSE {m('short_description', description=cut(text, S.DESCRIPTION))} END",
        m("topics", topics=f"CASE WHEN trim(topics) IN ('', '_') THEN {m('no_topics')} ELSE topics END"),
        f"CASE WHEN repo % 9 > 5 THEN {m('committers_found', committers=shown, remaining='(repo % 9 - 5)')} ELSE {m('committers_all', committers=shown)} END",
        when("first_line IS NOT NULL", m("first_grepscan_line", match="first_line")),
        *(when(f"{h} > 0", m("leaks_found_by_scanner", count=h, scanner=f"'{s}'")) for s, h in zip(SCANNERS, hits, strict=True)),
        m("total_leaks_found", total_count="(" + " + ".join(hits) + ")"),
        m("full_report_length", length="report_length"),
        f"CASE WHEN ai_related THEN {m('ai_analysis_company_related', confidence='ai_confidence')} WHEN NOT ai_related THEN {m('ai_analysis_company_unrelated', confidence='ai_confidence')} END",
        when("ai_related IS NOT NULL AND ai_level IN ('high', 'critical')", m("ai_analysis_high_severity", score="ai_score")),
        when("ai_related IS NOT NULL AND trim(ai_summary) <> ''", m("ai_analysis_summary", summary=cut("trim(ai_summary)", S.SUMMARY))),
        m("profitability_scores", org_rel="org_relevance", sens_data="sensitive", tp="unified_probability", fp="round(1 - unified_probability, 2)"),
    ]
    person = lambda i: m("corporate_committer_target" if i == 1 else "corporate_committer_other", name=f"'c{i}'", email=f"'c{i}@acme.com'", domain="'acme.com'")
    lines = [head, *(when(f"repo % 3 >= {i}", person(i)) for i in (1, 2)), *tail]
    fields = ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items())
    # a list of the lines, the first of equal ones
    return f", f AS (SELECT repo, {fields} FROM candidates), l AS (SELECT repo, list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL) AS ls FROM f) SELECT repo, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10) || '- ') AS status FROM l"


for _lang in ("en", "ru"):
    q(f"sco15_status_{_lang}", _status_sql(_lang), V.candidates)(lambda d, lang=_lang: _status(d, lang))

_REASON = "CASE WHEN repo % 3 = 0 THEN '' ELSE concat('closed by rule ', CAST(repo % 5 AS VARCHAR(9))) END"
q("orc20_close_reason", f"SELECT repo, CASE WHEN repo % 3 = 0 THEN 'head' || chr(10) || mid ELSE CASE WHEN repo % 2 = 0 THEN 'head' || chr(10) || mid || ' | ' || reason ELSE 'head' || chr(10) || mid || chr(10) || {_said('en', 'short_description', description="'- | ' || reason")} END END AS lines FROM (SELECT repo, {_REASON} AS reason, CASE WHEN repo % 2 = 0 THEN {_said('en', 'short_description', description='repo_name')} ELSE 'other' END AS mid FROM candidates)", V.candidates)(
    lambda d: d.select("repo", F.array_join(S.with_reason(F.array(F.lit("head"), F.when(c("repo") % 2 == 0, S.message("short_description", "en", description=c("repo_name"))).otherwise("other")), F.expr(_REASON.replace("VARCHAR(9)", "STRING")), "en"), "\n").alias("lines"))
)

# repositories that are worth asking for
q("flt06_readable", "SELECT c_custkey AS at FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 4 <> 0", lambda s, d: V.table(s, d, "customer"))(lambda d: G.readable(d.select(c("c_custkey").alias("at"), F.when(c("c_custkey") % 7 == 0, "not found").when(c("c_custkey") % 4 == 0, "size 0").alias("reason"))).select("at"))

# benchmark runs
_STATE = "CASE WHEN repo % 7 = 3 THEN 'too_large' WHEN repo % 7 = 5 THEN 'failed' ELSE 'ok' END"
_OUTCOME = "CASE WHEN meaningful = 0 THEN 'false' WHEN seq % 3 = 0 THEN 'review' ELSE 'real' END"
_scans = lambda d: d.select((c("repo") % 4).alias("company"), "dork", "repo", F.expr(_STATE).alias("state"), c("commits_count").alias("seconds"))
_found = lambda d: d.select((c("repo") % 4).alias("company"), "scanner", c("rule").alias("type"), F.expr(_OUTCOME).alias("outcome"))
_BENCH = f""", s AS (SELECT repo % 4 AS company, dork, repo, {_STATE} AS state, commits_count AS seconds FROM candidates), f AS (SELECT repo % 4 AS company, scanner, rule AS type, {_OUTCOME} AS outcome FROM repo_findings),
b AS (SELECT a.*, coalesce(findings, 0) AS findings, coalesce(real, 0) AS real, coalesce(false_positives, 0) AS false_positives, coalesce(review, 0) AS review FROM (SELECT company, count(DISTINCT dork) AS dorks, count(*) AS repos, count(*) FILTER (state = 'ok') AS scanned,
  count(*) FILTER (state = 'too_large') AS too_large, count(*) FILTER (state = 'failed') AS failed, CAST(sum(seconds) AS DOUBLE) AS seconds FROM s GROUP BY 1) a LEFT JOIN (SELECT company, count(*) AS findings, count(*) FILTER (outcome = 'real') AS real,
  count(*) FILTER (outcome = 'false') AS false_positives, count(*) FILTER (outcome = 'review') AS review FROM f GROUP BY 1) c USING (company))"""
_WHOLE = ("dorks", "repos", "scanned", "too_large", "failed", "findings", "real", "false_positives", "review")
_one = lambda x: f"coalesce(format('{{:.1f}}', CAST({x} AS DOUBLE)), '-')"
_TOTALS = " UNION ALL ".join(
    [f"SELECT 'totals' AS section, CAST({i} AS BIGINT) AS place, '{k}' AS key, CAST(CAST(sum({k}) AS BIGINT) AS VARCHAR) AS value FROM b" for i, k in enumerate(_WHOLE)]
    + [f"SELECT 'totals', {len(_WHOLE) + i}, '{k}', {_one(x)} FROM b" for i, (k, x) in enumerate({"success_rate": "sum(scanned) / greatest(sum(repos), 1) * 100", "precision": "sum(real) / greatest(sum(findings), 1) * 100", "repos_per_hour": "sum(scanned) / (sum(seconds) / 3600)", "secrets_per_hour": "sum(real) / (sum(seconds) / 3600)"}.items())]
)
_LINES = f"""{_TOTALS} UNION ALL SELECT 'scanners', -count(*), scanner, CAST(count(*) AS VARCHAR) FROM f GROUP BY scanner
UNION ALL SELECT * FROM (SELECT 'types', -count(*), type, CAST(count(*) AS VARCHAR) FROM f GROUP BY type ORDER BY count(*) DESC, type LIMIT 10)
UNION ALL SELECT 'companies', 0, CAST(company AS VARCHAR), dorks || ' | ' || repos || ' | ' || scanned || ' | ' || real || ' | ' || false_positives || ' | ' || CASE WHEN seconds > 0 THEN format('{{:.1f}}', scanned * 60 / seconds) ELSE '-' END FROM b"""
q("snk17_benchmark_lines", f"{_BENCH} {_LINES}", tables("candidates", "repo_findings"))(lambda t: B.report(_scans(t[0]), _found(t[1])))
_HEADS = " ".join(f"WHEN '{k}' THEN '## {k}' || chr(10) || chr(10) || '{v}'".replace("\n", "' || chr(10) || '") for k, v in B.HEADS.items())
q("snk17_benchmark_markdown", f"{_BENCH}, l AS ({_LINES}) SELECT section, CASE section {_HEADS} END || chr(10) || string_agg('| ' || key || ' | ' || value || ' |', chr(10) ORDER BY place, key) AS value FROM l GROUP BY section", tables("candidates", "repo_findings"))(
    lambda t: B.rendered(B.report(_scans(t[0]), _found(t[1])), "md")
)
q("srt12_planned", "SELECT company, repo FROM (SELECT c_custkey % 4 AS company, c_custkey AS repo FROM customer) QUALIFY row_number() OVER (PARTITION BY company ORDER BY repo) <= 100", lambda s, d: V.table(s, d, "customer"))(
    lambda d: B.planned(d.select((c("c_custkey") % 4).alias("company"), c("c_custkey").alias("repo")), ["repo"], B.MOST_REPOS)
)
q("set06_token_pool", "SELECT n_regionkey AS company, list_concat(list(n_name ORDER BY n_name) FILTER (n_nationkey % 2 = 0), list(n_name ORDER BY n_name) FILTER (n_nationkey % 2 = 1)) AS pool FROM nation GROUP BY 1", lambda s, d: V.table(s, d, "nation"))(
    lambda d: d.groupBy(c("n_regionkey").alias("company")).agg(*(F.array_sort(F.collect_list(F.when(c("n_nationkey") % 2 == k, c("n_name")))).alias(f"p{k}") for k in (0, 1))).select("company", B.pooled(c("p0"), c("p1")).alias("pool"))
)


# captures that are read in parts: written by Spark, as scanners write them, one array a line, then cut at braces


def split_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.repo_findings(spark, sf_dir)
    place = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    finding = F.struct((c("seq") % 7).alias("StartLine"), (c("seq") % 7 + 1).alias("EndLine"), F.lit(1).alias("StartColumn"), F.lit(2).alias("EndColumn"), c("match").alias("Match"), F.lit('a "quoted} {brace').alias("Message"), c("path").alias("File"), c("rule").alias("RuleID"))
    d.groupBy("repo", (c("seq") % 16).alias("part")).agg(F.collect_list(finding).alias("x")).select(F.to_json("x").alias("value")).write.text(place)
    return C.gitleaks_records(J.records(spark, place))


q("src23_split_capture", "SELECT 'gitleaks' AS scanner, path AS file, match, 'V:' || (seq % 7) || '-' || (seq % 7 + 1) || ';H:1-2;' AS position, rule FROM repo_findings WHERE match <> ''", lambda s, d: (s, d))(lambda a: split_findings(*a))

# pages of a report, rows of HTML with bars

_QUOTE = "''''"
_ESC = "replace(replace(replace(replace(replace(coalesce(CAST({x} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), " + _QUOTE + ", '&#x27;')"
_TD = lambda x: "'<td>' || " + _ESC.format(x=x) + " || '</td>'"
_BARS = "'<td><div class=\"bar\" style=\"width:' || CAST(round(cnt * 200 / max(cnt) OVER ()) AS INT) || 'px\"></div></td>'"
_KIND = "' <b> & ''x'''"
q(
    "snk12_report_lines",
    f", t AS (SELECT leak_type || {_KIND} AS kind, count(*) AS cnt FROM incidents GROUP BY 1), u AS (SELECT url, count(*) AS cnt FROM incidents GROUP BY 1) "
    f"SELECT 'Types' AS part, row_number() OVER (ORDER BY cnt DESC, kind) AS place, '<tr>' || {_TD('kind')} || {_TD('cnt')} || {_BARS} || '</tr>' AS html FROM t UNION ALL SELECT 'Addresses', row_number() OVER (ORDER BY url), '<tr>' || {_TD('url')} || {_TD('cnt')} || '</tr>' FROM u",
)(
    lambda d: H.page("Incidents", [
        H.section("Types", R.counts_by(d, F.concat("leak_type", F.lit(" <b> & 'x'")).alias("kind")), [F.desc("cnt"), "kind"], "cnt"),
        H.section("Addresses", R.counts_by(d, "url"), ["url"]),
    ]).where("place > 0 and place < 1000000000").select("part", "place", "html")
)

# what a run does, and a model's captured answers
_WAITING = "l AS (SELECT url, max(id) AS id, max_by((id // 7) % 6, id) AS result FROM incidents GROUP BY url), w AS (SELECT id, url, result, id // 100000 AS block FROM l WHERE result IN (4, 5) AND url LIKE 'https://github.com/%')"


def _jobs(leaks: DataFrame) -> DataFrame:
    every = [df.select(F.lit(name).alias("job"), "id", "url", "batch") for name, df in jobs.schedule(leaks)]
    return every[0].unionByName(every[1])


q("orc01_schedule", f", {_WAITING} SELECT CASE result WHEN 5 THEN 'deep' ELSE 'again' END AS job, id, url, block || '-' || ((row_number() OVER (PARTITION BY result, block ORDER BY id) - 1) // 5) AS batch FROM w")(
    lambda d: _jobs(d.withColumn("result", F.expr("cast((id div 7) % 6 as int)")))
)


def _answers(d: DataFrame) -> DataFrame:
    """Captured answers of two thirds of the repositories, in the forms that models give."""
    said = F.to_json(F.struct(F.struct((c("repo") % 2 == 0).alias("is_related"), (c("repo") % 10 / 10.0).alias("confidence")).alias("company_relevance"), F.struct(F.lit("high").alias("level"), (c("repo") % 4 / 4.0).alias("score")).alias("severity_assessment")))
    fence = F.lit("`" * 3)
    answer = F.when(c("repo") % 6 == 1, F.concat(fence, F.lit("json\n"), said, F.lit("\n"), fence)).when(c("repo") % 6 == 2, F.concat(F.lit("The verdict: "), said, F.lit(" as asked."))).when(c("repo") % 6 == 4, "no JSON here").otherwise(said)
    read = D.llm_json(answer)
    rows = d.where("repo % 3 > 0").select("repo", read.alias("read"), D.verdict_document(read).alias("v")).where("read is not null")
    answers = rows.select("repo", c("v.company_relevance.is_related").alias("ai_related"), c("v.company_relevance.confidence").alias("ai_confidence"), c("v.classification.true_positive_probability").alias("ai_tp"), c("v.severity_assessment.score").alias("ai_severity"))
    return jobs.with_answers(d.select("repo"), answers).select("repo", "ai_related", "ai_confidence", "ai_severity", "ai_result")


q("src29_answers", "SELECT repo, CASE WHEN k THEN repo % 2 = 0 END AS ai_related, CASE WHEN k THEN repo % 10 / 10.0::DOUBLE END AS ai_confidence, CASE WHEN k THEN repo % 4 / 4.0::DOUBLE END AS ai_severity, CASE WHEN k THEN CAST(repo % 2 = 0 AS INT) ELSE -1 END AS ai_result FROM (SELECT repo, repo % 3 > 0 AND repo % 6 <> 4 AS k FROM candidates)", V.candidates)(_answers)

# the chain of search, fetch and scan, as a table; the stream of it is tested against the same functions
_HIT = r"'(?i)(?:^|[^\p{L}\p{N}_])(license|the|das|une)(?:$|[^\p{L}\p{N}_])'"
q("stm02_stages", f""", cand AS (SELECT 'src' || (id % 20) AS repo, min(found_at) AS found_at FROM incidents WHERE (id % 7) * 60000 <= 300000 GROUP BY 1 HAVING repo <> 'src3'),
f AS (SELECT source AS repo, 'src/f' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.png' ELSE '.py' END AS path, text, TIMESTAMP '2024-01-01' + to_seconds(CAST(doc_id % 1500 * 60 AS DOUBLE)) AS read_at FROM documents),
m AS (SELECT f.repo, path, text FROM cand JOIN f ON f.repo = cand.repo AND read_at >= found_at AND read_at <= found_at + INTERVAL 6 HOUR WHERE path LIKE '%.py'),
n AS (SELECT repo, path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM m)
SELECT repo, path, line_no, regexp_extract(trim(t), {_HIT}, 1) AS term FROM n WHERE length(trim(t)) BETWEEN 1 AND 1000 AND regexp_matches(trim(t), {_HIT})""", tables("incidents", "documents"))(
    lambda t: T.scanned(T.fetched(T.searched(t[0].select(F.concat(F.lit("src"), c("id") % 20).alias("repo"), "found_at", ((c("id") % 7) * 60000).alias("size")), t[0].sparkSession.createDataFrame([("src3",)], "repo string")),
        t[1].select(c("source").alias("repo"), F.concat(F.lit("src/f"), "doc_id", F.when(c("doc_id") % 4 == 0, ".png").otherwise(".py")).alias("path"), "text", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 1500 as int), 0)").alias("read_at"))), ["license", "the", "das", "une"]).select("repo", "path", "line_no", "term")
)
