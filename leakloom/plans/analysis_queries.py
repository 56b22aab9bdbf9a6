"""Queries of classification, scores and verdicts, over findings, committers and candidates, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import rules as R
from leakloom.functions import text as T
from leakloom.operators import analysis as A
from leakloom.operators import scoring as S

from . import sql
from . import views as V
from .catalog import ORACLE_SQL, c, q, tables
from .views import ORACLE_VIEWS

AS_OF = "2024-06-01"

# classes of strings: predicates over shapes that hit and miss each rule
_T = "t"
q(
    "str_shapes",
    f"""SELECT k, shape, {sql.repetitive(_T)} AS repetitive, {sql.encoded(_T)} AS encoded, {sql.base64(_T)} AS pure_base64, {sql.placeholder(_T)} AS placeholder, {sql.example(_T)} AS example,
    {sql.any_in('lower(t)', R.LOCAL_HOSTS)} AS local_host, {sql.structured(_T)} AS structured, {sql.random_with(_T, ['acme', 'zq'])} AS random_with, {sql.any_in('lower(t)', R.TUTORIAL_MARKS)} AS tutorial FROM shapes""",
    V.shapes,
)(
    lambda d: d.select(
        "k", "shape", T.has_repetitive_pattern(c("t")).alias("repetitive"), T.looks_like_encoded(c("t")).alias("encoded"), T.is_pure_base64(c("t")).alias("pure_base64"), T.is_known_placeholder(c("t")).alias("placeholder"), T.is_known_example_secret(c("t")).alias("example"),
        T.contains_local_host(c("t")).alias("local_host"), T.has_meaningful_structure(c("t")).alias("structured"), T.is_random_with_keyword(c("t"), ["acme", "zq"]).alias("random_with"), T.is_tutorial_repository(c("t")).alias("tutorial"),
    )
)
q("str01_all_rules", f"SELECT repo, file, rule, seq, {sql.repetitive('match')} AS rep FROM findings", V.findings)(lambda d: d.select("repo", "file", "rule", "seq", T.has_repetitive_pattern(c("match")).alias("rep")))
_KIND = sql.secret_type("''", "t", "''")
# type and entropy as columns, computed once a row however often scores use them
_typed = lambda d: d.withColumns({"kind": S.secret_class(F.lit(""), c("t"), F.lit(""))["type"], "bits": T.entropy(c("t"))})
q("mth03_cls03_scores", f"SELECT k, shape, round({sql.entropy_score(sql.entropy(_T), f'({_KIND})')}, 6) AS entropy_score, round({sql.format_score(_T, f'({_KIND})')}, 6) AS format_score FROM shapes", V.shapes)(
    lambda d: _typed(d).select("k", "shape", F.round(S.entropy_score(c("bits"), c("kind")), 6).alias("entropy_score"), F.round(S.format_score(c("t"), c("kind")), 6).alias("format_score"))
)
q("path_rules", f"SELECT DISTINCT path, {sql.binary('path')} AS bin, {sql.mock('path')} AS mock, {sql.false_path('path')} AS false_path, {sql.any_in('lower(path)', R.TEMPLATE_MARKS)} AS template, {sql.framework('path')} AS framework FROM repo_findings", V.repo_findings)(
    lambda d: d.select("path", P.is_binary_file(c("path")).alias("bin"), P.is_mock_path(c("path")).alias("mock"), P.is_false_positive_path(c("path")).alias("false_path"), P.is_template_config(c("path")).alias("template"), P.is_framework_path(c("path")).alias("framework")).distinct()
)

# findings
_RMP = ("rule", "match", "path")
_CLASS = f"repo, scanner, seq, {sql.secret_type(*_RMP)} AS type, round({sql.secret_weight(*_RMP)}, 6) AS weight"
q("cls01_class_by_path", f"SELECT {_CLASS} FROM repo_findings", V.repo_findings)(lambda d: d.select("repo", "scanner", "seq", S.secret_class(c("rule"), c("match"), c("path")).alias("k")).select("repo", "scanner", "seq", "k.type", F.round("k.weight", 6).alias("weight")))
q("cls02_context", f"SELECT repo, scanner, seq, round({sql.context('path', 'match')}, 6) AS score FROM repo_findings", V.repo_findings)(lambda d: d.select("repo", "scanner", "seq", F.round(S.context_score(c("path"), F.lit(""), c("match"), F.lit("")), 6).alias("score")))
q("cls04_by_path", f"SELECT repo, scanner, seq, round({sql.validity('match', 'path', 'type', '0.4', ['acme'])}, 6) AS validity FROM (SELECT *, {sql.secret_type(*_RMP)} AS type FROM repo_findings)", V.repo_findings)(
    lambda d: d.select("repo", "scanner", "seq", F.round(S.validity(c("match"), c("path"), S.secret_class(c("rule"), c("match"), c("path"))["type"], F.lit(0.4), company_words=["acme"]), 6).alias("validity"))
)
q("cls04_shapes", f"SELECT k, shape, round({sql.validity('t', 'p', 'type', '0.5')}, 6) AS validity FROM (SELECT k, shape, t, 'src/app.py' AS p, {_KIND} AS type FROM shapes)", V.shapes)(
    lambda d: _typed(d).withColumn("structured", T.has_meaningful_structure(c("t"))).select("k", "shape", F.round(S.validity(c("t"), F.lit("src/app.py"), c("kind"), F.lit(0.5), bits=c("bits"), structured=c("structured")), 6).alias("validity"))
)
# the two queries whose path is always the same
ORACLE_SQL["cls01_secret_class"] = ORACLE_VIEWS + f"SELECT repo, file, rule, seq, {sql.secret_type('rule', 'match', 'p')} AS type, {sql.secret_weight('rule', 'match', 'p')} AS weight FROM (SELECT *, 'src/app.py' AS p FROM findings)"
ORACLE_SQL["cls04_validity"] = ORACLE_VIEWS + f"SELECT repo, file, rule, seq, round({sql.validity('match', 'p', 'type', '0.5')}, 6) AS validity FROM (SELECT *, {sql.secret_type('rule', 'match', 'p')} AS type FROM (SELECT *, 'src/app.py' AS p FROM findings))"

# candidates: words of the company, committers, paths
_STOP = "'the','and','of','for','in','on','at','to','a','an'"
_INITIALS = "array_to_string(list_transform({}, lambda w: left(w, 1)), '')"
_TOKENS = f"""tok AS (SELECT *, list_filter(string_split_regex(lower(company_name), '[\\s\\-_.,()&]+'), lambda w: w <> '') AS ws FROM candidates),
tk AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(list_concat([lower(company_name)], list_filter(ws, lambda w: length(w) > 2)), [{_INITIALS.format('ws')}, {_INITIALS.format(f"list_filter(ws, lambda w: length(w) > 2 AND w NOT IN ({_STOP}))")}]), lambda t: length(t) > 1))) AS tokens,
    list_filter(string_split_regex(lower(dork), '[\\s,._-]+'), lambda t: length(t) > 2) AS dts FROM tok)"""


def _any(text: str, tokens: str = "tokens") -> str:
    return f"len(list_filter({tokens}, lambda t: contains({text}, t))) > 0"


_ENDS = " OR ".join(["suffix(stem, t)", *(f"suffix(stem, t || '{s}')" for s in R.COMPANY_SUFFIXES)])
_MAIL = f"(CASE WHEN domain = '' THEN 0 WHEN len(list_filter(tokens, lambda t: length(t) >= 3 AND ({_ENDS} OR (length(t) > 4 AND contains(stem, t || '-'))))) > 0 THEN 1.0 ELSE greatest(0, (CASE WHEN {_any('domain')} THEN 0.7 ELSE 0 END) - (CASE WHEN {sql.one_of('domain', R.PUBLIC_DOMAINS)} THEN 0.2 ELSE 0 END)) END)"
_COMMITTERS = f"""{_TOKENS},
cm0 AS (SELECT m.repo, m.name, lower(m.email) AS mail, lower(trim(string_split(m.email, '@')[-1])) AS domain, lower(concat_ws(' ', m.name, m.email)) AS info, lower(tk.dork) AS dork, tokens, dts, country FROM committers m JOIN tk ON m.repo = tk.repo),
cm1 AS (SELECT *, regexp_extract(domain, '^(.*)\\.(?:com|ru|org|net|io|gov)$', 1) AS stem, domain <> '' AND NOT ({sql.one_of('domain', R.PUBLIC_DOMAINS)} OR {sql.any_in('domain', R.NOREPLY_MARKS)}) AS corp,
    regexp_matches(mail, '@.+\\.(com|org|net|io)$') AS abroad, regexp_matches(name, '[Ѐ-ӿ]') AS cyr FROM cm0),
cm2 AS (SELECT *, {_MAIL} AS ms FROM cm1),
cm AS (SELECT repo, least(sum((CASE WHEN contains(info, dork) THEN 0.05 ELSE 0 END) + (CASE WHEN {_any('info')} THEN 0.1 ELSE 0 END) + 0.4 * ms)::DOUBLE, 0.5) AS committer_signal,
    sum(CASE country WHEN 'ru' THEN (CASE WHEN cyr THEN 0.2 ELSE 0 END) + (CASE WHEN suffix(mail, '.ru') THEN 0.2 ELSE 0 END) - (CASE WHEN abroad THEN 0.1 ELSE 0 END)
      ELSE (CASE WHEN regexp_full_match(name, '[A-Za-z ._-]+') THEN 0.02 ELSE 0 END) + (CASE WHEN abroad THEN 0.02 ELSE 0 END) END)::DOUBLE AS country_signal,
    bool_or(corp) AS corporate, bool_and(NOT corp) AS all_public, bool_or(corp AND {_any('domain')}) AS company_committer, bool_and(country = 'ru' AND NOT cyr AND NOT suffix(mail, 'ru')) AS all_foreign,
    bool_or(domain <> '' AND ({_any('domain')} OR {_any('domain', 'dts')} OR ms >= 0.7)) AS committer_domain, count(DISTINCT (name, mail)) AS people FROM cm2 GROUP BY repo)"""
q("agg26_committer_signals", f", {_COMMITTERS} SELECT repo, round(committer_signal, 6) AS committer_signal, round(country_signal, 6) AS country_signal, corporate, all_public, company_committer, all_foreign, committer_domain, people FROM cm", tables("committers", "candidates"))(
    lambda t: A.committer_signals(*t).withColumns({k: F.round(k, 6) for k in ("committer_signal", "country_signal")})
)

_ONE = f"""CASE WHEN {sql.false_path('path')} THEN -0.1 WHEN {sql.framework('path')} THEN -0.05 ELSE
    coalesce(list_sum(list_transform(tokens, lambda t: (CASE WHEN list_contains(parts, t) THEN 0.4 WHEN len(list_filter(parts, lambda x: contains(x, t))) > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN contains(path, 'com/' || t) OR contains(path, 'com.' || t) THEN 0.5 ELSE 0 END)
      + (CASE WHEN position(t IN path) > 0 AND regexp_matches(substr(path, position(t IN path) + length(t)), 'config|properties|credentials|auth|secret|key') THEN 0.3 ELSE 0 END))), 0) - (CASE WHEN {sql.binary('path')} THEN 0.3 ELSE 0 END) END"""
_PATHS = f"""{_COMMITTERS},
fp0 AS (SELECT f.repo, lower(path) AS path, tokens, string_split_regex(lower(path), '[/\\\\.]') AS parts FROM repo_findings f JOIN tk ON f.repo = tk.repo),
ps AS (SELECT repo, greatest(0, least(1, sum({_ONE})::DOUBLE * CASE WHEN count(*) FILTER ({sql.false_path('path')}) > 0.5 * count(*) THEN 0.5 ELSE 1 END)) AS path_score FROM fp0 GROUP BY repo),
ts AS (SELECT f.repo, bool_or({_any("lower(concat_ws(' ', path, match))")} OR {_any("lower(concat_ws(' ', path, match))", 'dts')}) AS text_signal FROM repo_findings f JOIN tk ON f.repo = tk.repo GROUP BY f.repo)"""
q("sco03_path_signals", f", {_PATHS} SELECT repo, round(path_score, 6) AS path_score FROM ps", tables("repo_findings", "candidates"))(lambda t: A.path_signals(*t).withColumn("path_score", F.round("path_score", 6)))


def _when(cond: str, w: object) -> str:
    return f"(CASE WHEN {cond} THEN {w} ELSE 0 END)"


_FOREIGN = "length(regexp_replace(description, '[^" + "".join(f"{a}-{b}" for a, b in R.FOREIGN_SCRIPTS) + "]', '', 'g')) / greatest(length(description), 1)"
_RELEVANCE = " + ".join(
    [
        _when("contains(lower(repo_name), lower(dork))", 0.25),
        _when("contains(lower(description), lower(dork))", 0.15),
        "least(0.16, 0.08 * len(list_filter(tokens, lambda t: contains(lower(description), t))))",
        _when("author_name <> '' AND contains(lower(author_name), lower(dork))", 0.25),
        _when("contains(lower(repo_name), lower(dork)) AND contains(lower(author_name), lower(dork))", 0.1),
        "coalesce(committer_signal, 0)",
        _when(_any("lower(repo_name)"), 0.3),
        _when(_any("lower(description)"), 0.1),
        _when(_any("lower(topics)"), 0.05),
        "0.35 * coalesce(path_score, 0)",
        f"-(CASE WHEN {_FOREIGN} > 0.2 THEN 0.4 WHEN {_FOREIGN} > 0.05 THEN 0.3 ELSE 0 END)",
        "coalesce(country_signal, 0)",
        _when("country = 'ru' AND regexp_matches(author_name, '[Ѐ-ӿ]')", 0.2),
        _when("country = 'ru' AND regexp_matches(description, '[Ѐ-ӿ]')", 0.2),
        _when("country = 'en' AND regexp_full_match(author_name, '[A-Za-z ._-]+')", 0.03),
        _when("country = 'en' AND regexp_full_match(trim(description), '[A-Za-z0-9 ,._-]+')", 0.03),
        _when("ai_related", "0.5 * ai_confidence + 0.1"),
        "-" + _when("NOT ai_related", "0.3 * ai_confidence + 0.1"),
    ]
)
_SMALL = "(CAST(size < 100 AS INT) + CAST(stargazers_count <= 50 AND forks_count <= 2 AS INT) + CAST(contributors_count <= 1 AS INT))"
_CRED = f"""greatest(0, least(1, CAST(0.5 + (CASE WHEN company_committer THEN 0.5 WHEN corporate THEN 0.1 WHEN all_public THEN -0.1 ELSE 0 END)
    + (CASE WHEN NOT corporate THEN (CASE WHEN size < 10 THEN -0.1 WHEN size < 100 THEN -0.05 ELSE 0 END) + {_when(_SMALL + ' >= 2', -0.05)} ELSE 0 END)
    + (CASE WHEN stargazers_count >= 5000 THEN -0.1 WHEN stargazers_count >= 500 OR forks_count >= 100 OR contributors_count >= 20 THEN -0.05 ELSE 0 END)
    - (CASE WHEN NOT fork THEN 0 WHEN commits_count > 100 AND forks_count < 2 THEN 0.2 ELSE 0.4 END) + {_when(f"date_diff('day', created_at::DATE, DATE '{AS_OF}') > 2920", -0.1)} + {_when('all_foreign', -0.1)} AS DOUBLE)))"""
_ORG = f"""{_PATHS},
b0 AS (SELECT tk.*, coalesce(corporate, false) AS corporate, coalesce(all_public, false) AS all_public, coalesce(company_committer, false) AS company_committer, coalesce(all_foreign, false) AS all_foreign, coalesce(committer_domain, false) AS committer_domain,
    coalesce(text_signal, false) AS text_signal, committer_signal, country_signal, path_score FROM tk LEFT JOIN cm USING (repo) LEFT JOIN ps USING (repo) LEFT JOIN ts USING (repo)),
b1 AS (SELECT *, {_CRED} AS cred, CAST({_RELEVANCE} AS DOUBLE) AS rel FROM b0),
b2 AS (SELECT *, least(1, round(greatest(0, CASE WHEN company_committer THEN greatest(rel, 0.75) ELSE rel END) * (CASE WHEN company_committer THEN 0.8 + 0.2 * cred ELSE 0.7 + 0.3 * cred END), 9)) AS org FROM b1)"""
_RANK = "(CASE scanner " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(R.SCANNER_WEIGHTS)) + " END)"
_BASE = "(CASE scanner " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in R.SCANNER_WEIGHTS.items()) + " END)"
_LOW = "'" + "','".join(R.LOW_VALUE_TYPES) + "'"
_SENS = f"""{_ORG},
s0 AS (SELECT f.*, cred, {sql.secret_type(*_RMP)} AS type, {sql.secret_weight(*_RMP)} AS weight FROM repo_findings f JOIN b2 USING (repo)),
s1 AS (SELECT *, {_BASE} AS base, row_number() OVER (PARTITION BY repo, left(match, 100) ORDER BY {_RANK}, seq, path) AS nth FROM s0 WHERE meaningful <> 0),
s2 AS (SELECT *, {sql.entropy('match')} AS e, {sql.least_entropy('type')} AS m, {sql.validity('match', 'path', 'type', 'cred')} AS v FROM s1 WHERE nth = 1),
s3 AS (SELECT repo, {sql.binary('path')} OR e < 0.5 * m OR v < 0.1 AS fp, {sql.base64('match')} AS blob,
    greatest(0, base * weight * (CASE WHEN {sql.repetitive('match')} THEN 0.3 ELSE 1 END) * (CASE WHEN e < m THEN 0.4 ELSE 1 END) * v + 0.3 * {sql.context('path', 'match')}) AS score FROM s2),
s4 AS (SELECT repo, count(*) AS n, count(DISTINCT type) FILTER (type NOT IN ({_LOW})) AS valuable FROM s1 GROUP BY repo),
s5 AS (SELECT repo, count(*) AS vals, count(*) FILTER (fp) AS fp, coalesce(sum(score) FILTER (NOT fp), 0) AS total, count(*) FILTER (NOT fp AND score > 0.5) AS high, count(*) FILTER (NOT fp AND blob) AS blobs FROM s3 GROUP BY repo),
s6 AS (SELECT repo, count(DISTINCT scanner) AS scanners FROM repo_findings GROUP BY repo),
s7 AS (SELECT b2.*, coalesce(n, 0) AS n, coalesce(valuable, 0) AS valuable, coalesce(vals, 0) AS vals, coalesce(fp, 0) AS fp, coalesce(total, 0) AS total, coalesce(high, 0) AS high, coalesce(blobs, 0) AS blobs, coalesce(scanners, 0) AS scanners
    FROM b2 LEFT JOIN s4 USING (repo) LEFT JOIN s5 USING (repo) LEFT JOIN s6 USING (repo)),
s8 AS (SELECT *, total * (CASE WHEN fp / greatest(n, 1) > 0.8 THEN 0.3 WHEN fp / greatest(n, 1) > 0.5 THEN 0.6 ELSE 1 END) * (CASE WHEN n > 0 AND valuable = 0 THEN 0.2 ELSE 1 END)
    * (CASE WHEN n > fp AND blobs >= n - fp THEN 0.15 WHEN n > fp AND blobs / (n - fp) >= 0.7 THEN 0.4 WHEN n > fp AND blobs / (n - fp) >= 0.4 THEN 0.7 ELSE 1 END) AS t FROM s7),
s9 AS (SELECT *, (CASE WHEN n > fp THEN least(t / 3, 1) + (CASE WHEN valuable > 2 THEN 0.1 WHEN valuable >= 1 THEN 0.05 ELSE 0 END) + least(0.2, 0.07 * high) + (CASE WHEN scanners > 2 THEN 0.15 WHEN scanners >= 2 THEN 0.08 ELSE 0 END)
    + 0.1 + (CASE WHEN n - fp >= 3 THEN 0.1 ELSE 0 END) ELSE 0 END) + (CASE WHEN ai_severity > 0.5 THEN 0.1 * ai_severity ELSE 0 END) AS u FROM s8),
sd AS (SELECT *, least(1, round(CAST(CASE WHEN company_committer THEN greatest(u, 0.5) + 0.15 ELSE u END AS DOUBLE), 9)) AS sens FROM s9)"""
_UP = [("n > 0 AND org >= 0.15", 0.5), ("n >= 5 AND org >= 0.15", 0.6), ("n > 0 AND org < 0.15", 0.15), ("n >= 10 AND org < 0.15", 0.25), ("sens >= 0.7 AND org >= 0.1", 0.55), ("sens >= 0.5 AND org >= 0.1", 0.4), ("company_committer", 0.8)]
_FULL = f"""{_SENS},
t0 AS (SELECT *, round(least(1, greatest(0.5 * org + 0.5 * sens, {', '.join(_when(cond, w) for cond, w in _UP)})::DOUBLE), 9) AS tp FROM sd),
t1 AS (SELECT *, round(1 - tp, 9) AS fpc, (CASE WHEN ai_related IS NOT NULL AND ai_tp > 0 THEN 0.6 * tp + 0.4 * ai_tp ELSE tp END) * (CASE WHEN NOT ai_related AND ai_confidence >= 0.6 THEN greatest(0.3, 1 - 0.5 * ai_confidence) ELSE 1 END)
    * (CASE WHEN NOT company_committer AND NOT corporate AND cred < 0.35 THEN 0.85 ELSE 1 END) AS p FROM t0),
t2 AS (SELECT *, round(greatest(0, least(1, p)), 9) AS uni, NOT company_committer AND org < 0.25 AND NOT ({_any('lower(repo_name)')} OR {_any('lower(repo_name)', 'dts')} OR {_any('lower(description)')} OR {_any('lower(description)', 'dts')} OR committer_domain OR text_signal) AS ins FROM t1),
t3 AS (SELECT *, NOT company_committer AND ((fpc >= 0.8 AND tp <= 0.2 AND sens <= 0.2) OR (cred < 0.3 AND org < 0.25) OR (org < 0.05 AND sens <= 0.2)) AS ind FROM t2),
fa AS (SELECT *, CASE WHEN company_committer THEN 4 WHEN (uni <= 0.1 AND org < 0.1) OR (uni <= 0.2 AND ind AND ins) THEN 0 WHEN uni <= 0.2 AND (ind OR ins) THEN 5 ELSE 4 END AS result FROM t3)"""

_three = tables("candidates", "committers", "repo_findings")
_day = lambda: F.lit(AS_OF).cast("date")


def _analysed(t: list):
    return A.full_analysis(*t, _day(), digits=9)


q("sco02_relevance", f", {_ORG} SELECT repo, round(org, 6) AS org, round(cred, 6) AS cred FROM b2", _three)(lambda t: _analysed(t).select("repo", F.round("org_relevance", 6).alias("org"), F.round("credibility", 6).alias("cred")))
q("sco06_sensitive", f", {_SENS} SELECT repo, round(sens, 6) AS sens, n, fp, vals FROM sd", _three)(
    lambda t: A.sensitive_data(t[2], A._with_signals(*t, _day()), 9).select("repo", F.round("sensitive", 6).alias("sens"), c("secrets").alias("n"), c("false_positives").alias("fp"), c("distinct_values").alias("vals"))
)
q("sco13_full_analysis", f", {_FULL} SELECT repo, round(tp, 6) AS tp, round(uni, 6) AS uni, ins, CASE WHEN uni >= 0.7 THEN 2 WHEN uni >= 0.5 THEN 1 ELSE 0 END AS level, result, CASE WHEN company_committer THEN true WHEN result = 4 THEN uni >= 0.5 ELSE false END AS high, size < 10 AS tiny, {_SMALL} >= 2 AS personal FROM fa", _three)(
    lambda t: _analysed(t).select("repo", F.round("true_positive_chance", 6).alias("tp"), F.round("unified_probability", 6).alias("uni"), c("insufficient").alias("ins"), "level", "result", c("high_priority").alias("high"), c("is_tiny").alias("tiny"), c("is_personal").alias("personal"))
)
q(
    "sco14_detailed",
    f""", {_ORG}, k AS (SELECT repo, scanner, match, {sql.secret_type(*_RMP)} AS type FROM repo_findings),
    g AS (SELECT repo, count(*) AS total, count(*) FILTER ({sql.entropy('match')} >= {sql.least_entropy('type')}) AS high, count(*) FILTER ({sql.placeholder('match')}) AS known, count(DISTINCT scanner) AS scanners, count(DISTINCT type) AS types FROM k GROUP BY repo)
    SELECT b2.repo, total, high, total - high AS low, known, scanners, types, fork AS is_fork, contains(lower(repo_name), lower(dork)) AS dork_relevance, corporate, company_committer AS target, stargazers_count > 500 AS popular FROM b2 LEFT JOIN g USING (repo)""",
    _three,
)(
    lambda t: A.detailed_analysis(*t, _day()).select(
        "repo", c("total_secrets").alias("total"), c("high_entropy_count").alias("high"), c("low_entropy_count").alias("low"), c("placeholder_count").alias("known"), F.size("by_scanner").cast("long").alias("scanners"), F.size("by_type").cast("long").alias("types"),
        "is_fork", "dork_relevance", c("corporate_email_found").alias("corporate"), c("target_company_email_found").alias("target"), c("high_popularity").alias("popular"),
    )
)
q("srt06_corporate_committers", f", {_COMMITTERS} SELECT m.repo, m.id, m.name, m.email, lower(trim(string_split(m.email, '@')[-1])) AS domain, {_any('lower(m.email)')} AND len(list_filter(tokens, lambda t: contains(lower(trim(string_split(m.email, '@')[-1])), t))) > 0 AS matches_company FROM committers m JOIN tk ON m.repo = tk.repo WHERE NOT ({sql.one_of(chr(34) + 'dom' + chr(34), R.PUBLIC_DOMAINS)})".replace('"dom"', "lower(trim(string_split(m.email, '@')[-1]))") + " AND NOT " + sql.any_in("lower(trim(string_split(m.email, '@')[-1]))", R.NOREPLY_MARKS), tables("committers", "candidates"))(lambda t: A.corporate_committers(*t))
q("agg24_stats_summary_all", "SELECT count(*) AS n, round(avg(size), 6) AS avg_size, round(avg(forks_count), 6) AS avg_forks, round(avg(stargazers_count), 6) AS avg_stars FROM candidates WHERE repo IN (SELECT id % 37 FROM incidents WHERE level >= 2)", tables("candidates", "incidents"))(
    lambda t: t[0].join(t[1].where("level >= 2").select((c("id") % 37).alias("repo")).distinct(), "repo", "left_semi").agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(y) for x, y in (("size", "avg_size"), ("forks_count", "avg_forks"), ("stargazers_count", "avg_stars"))))
)
q("set04_context_tokens", f", {_TOKENS} SELECT repo, list_sort(list_distinct(list_concat(tokens, dts))) AS t FROM tk", V.candidates)(lambda d: d.select("repo", F.array_sort(A.context_tokens()).alias("t")))
q("cls14_email_score", f", e AS (SELECT id, lower(trim(string_split(email, '@')[-1])) AS domain, ['acme', 'mail', 'co', 'hub'] AS tokens, email FROM committers), s AS (SELECT *, regexp_extract(domain, '^(.*)\\.(?:com|ru|org|net|io|gov)$', 1) AS stem FROM e) SELECT id, {_MAIL}::DOUBLE AS score FROM s", V.committers)(
    lambda d: d.select("id", A.email_score(c("email"), F.array(*map(F.lit, ("acme", "mail", "co", "hub")))).alias("score"))
)
q("cls13_domains", "SELECT k, shape, " + " OR ".join([f"suffix(d, 'zeta{x}.{t}')" for x in ["", *R.COMPANY_SUFFIXES] for t in ("com", "ru", "io")]) + " AS hit FROM (SELECT k, shape, ['zeta', 'x.zeta', 'zetabank', 'zetas', 'my-zeta', 'zeta-x', 'az'][CAST(k % 7 AS INT) + 1] || ['.com', '.ru', '.io', '.de', '.com.q'][CAST(shape % 5 AS INT) + 1] AS d FROM shapes)", V.shapes)(
    lambda d: d.select("k", "shape", A.company_domain(F.concat(V._pick(("zeta", "x.zeta", "zetabank", "zetas", "my-zeta", "zeta-x", "az"), "k % 7"), V._pick((".com", ".ru", ".io", ".de", ".com.q"), "shape % 5")), F.lit("zeta")).alias("hit"))
)
