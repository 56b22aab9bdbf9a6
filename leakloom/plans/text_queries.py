"""Queries of findings: normalisation, search, judgement, and of text, path and JSON functions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import documents as J
from leakloom.functions import rules as R
from leakloom.functions import text as T
from leakloom.operators import analysis as A
from leakloom.operators import findings as N
from leakloom.operators import ranking
from leakloom.operators import tables as D
from leakloom.operators.people import committers_first_seen
from leakloom.sources import captures as C

from . import sql
from . import views as V
from .catalog import ORACLE_SQL, c, q, tables
from .views import ORACLE_VIEWS

_by_table = lambda n: lambda s, d: V.table(s, d, n)
docs = _by_table("documents")

# normalised findings
_raw = lambda d: d.select("repo", "scanner", "seq", "match", c("path").alias("file"), "rule")
_CUT = "CASE WHEN length(match) > 100 THEN left(match, 100) || '...' ELSE match END"
_FIRST = "f200 AS (SELECT * FROM repo_findings QUALIFY row_number() OVER (PARTITION BY repo, scanner ORDER BY seq) <= 200), once AS (SELECT * FROM f200 QUALIFY row_number() OVER (PARTITION BY repo, scanner, match, path ORDER BY seq) = 1)"
q("orc04_normalised", f", {_FIRST} SELECT repo, scanner, seq, {_CUT} AS match, path AS file, rule, row_number() OVER (PARTITION BY repo, scanner ORDER BY seq) - 1 AS leak_no FROM once", V.repo_findings)(lambda d: N.normalised(_raw(d)).withColumn("leak_no", c("leak_no").cast("long")))
q("win03_cap_200", "SELECT repo, file, rule, seq FROM findings QUALIFY row_number() OVER (PARTITION BY repo, rule ORDER BY file, seq) <= 200", V.findings)(lambda d: ranking.capped(d, ["repo", "rule"], ["file", "seq"], N.KEPT).drop("match"))
_ORDER = "(CASE scanner " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(R.SCANNERS)) + " END)"
q("cls10_unified", f"SELECT repo, scanner, seq, trim(match) AS match FROM repo_findings WHERE trim(match) NOT IN ('', '...') QUALIFY row_number() OVER (PARTITION BY repo, left(lower(trim(match)), 50) ORDER BY {_ORDER}, seq) = 1", V.repo_findings)(lambda d: N.unified(_raw(d)).select("repo", "scanner", "seq", "match"))
q("orc03_fan_in", "SELECT scanner, count(*) AS n, count(rule) AS rules FROM (SELECT scanner, rule FROM repo_findings WHERE scanner = 'gitleaks' UNION ALL SELECT scanner, NULL FROM repo_findings WHERE scanner = 'grepscan') GROUP BY scanner", V.repo_findings)(
    lambda d: N.fan_in([d.where("scanner = 'gitleaks'").select("repo", "scanner", "match", "rule"), d.where("scanner = 'grepscan'").select("repo", "scanner", "match")]).groupBy("scanner").agg(F.count("*").alias("n"), F.count("rule").alias("rules"))
)
q("orc03_messages", "SELECT repo, 'No leaks found for dork \"' || dork || '\" in repository' AS message FROM candidates WHERE repo NOT IN (SELECT repo FROM repo_findings WHERE rule = 'email')", tables("candidates", "repo_findings"))(lambda t: N.messages(t[0].select("repo", "dork"), t[1].where("rule = 'email'")))
q("prj05_cleaned", "SELECT repo, match, path AS \"File\" FROM repo_findings", V.repo_findings)(lambda d: N.cleaned(d.select("repo", "match", c("path").alias("File"), c("match").alias("Secret"), F.lit(1).alias("StartLine"), F.lit("x").alias("Raw"))))
q("prj06_standard", "SELECT repo, match, path AS file, rule FROM repo_findings", V.repo_findings)(lambda d: d.select("repo", N.standard(c("match"), c("path"), rule=c("rule")).alias("r")).select("repo", "r.*"))
q("agg27_meaningful", "SELECT repo, count(*) FILTER (meaningful <> 0) AS n FROM repo_findings GROUP BY repo", V.repo_findings)(N.findings_count)
q("agg32_with_totals", "SELECT repo, scanner, count(*) AS hits FROM repo_findings GROUP BY ALL UNION ALL SELECT repo, NULL, count(*) FROM repo_findings GROUP BY repo", V.repo_findings)(N.scanner_hits)
q("set01_all_scanners", "SELECT repo, match, bool_or(scanner = 'gitleaks') AS leaks FROM repo_findings GROUP BY ALL", V.repo_findings)(lambda d: N.fan_in([d.where(c("scanner") == s) for s in R.SCANNERS]).groupBy("repo", "match").agg(F.bool_or(c("scanner") == "gitleaks").alias("leaks")))
q("ded07_in_order", "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS w FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents)", docs)(lambda d: d.select("doc_id", F.array_join(N.in_order(F.split(F.lower("text"), "[^a-z]+")), " ").alias("w")))

# search in lines
_TERM = r"'(?i)(?:^|[^\p{L}\p{N}_])(license|the|das|une)(?:$|[^\p{L}\p{N}_])'"
_LINES = f"hits AS (SELECT repo, file, line_no, trim(text) AS t FROM repo_lines WHERE length(trim(text)) BETWEEN 1 AND 1000 AND regexp_matches(trim(text), {_TERM})), h50 AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY repo, file ORDER BY line_no) <= 50), hn AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line_no) AS n, count(*) OVER (PARTITION BY repo) AS many FROM h50)"
q("win05_searched", f", {_LINES} SELECT repo, file, line_no, regexp_extract(t, {_TERM}, 1) AS term FROM hn WHERE many < 400 OR n <= 200", V.repo_lines)(lambda d: N.searched(d, ["the", "license", "das", "une"]).select("repo", "file", "line_no", "term"))
q("win04_cap_per_file", f", {_LINES} SELECT repo, file, line_no FROM h50", V.repo_lines)(lambda d: D.capped(d.where(F.length(F.trim("text")).between(1, 1000) & F.trim("text").rlike(N.term_pattern(["the", "license", "das", "une"]))), ["repo", "file"], ["line_no"], N.LINES_A_FILE).select("repo", "file", "line_no"))
_ENDS = "|".join(R.TEXT_ENDINGS)
_NAME = "lower(regexp_extract(p, '[^/\\\\]*$'))"
q("flt07_text_files", f"SELECT k, shape, regexp_matches({_NAME}, '^.+\\.({_ENDS})$') OR {sql.one_of(_NAME, R.TEXT_NAMES)} OR regexp_matches({_NAME}, '^(license|changelog|install)\\.') OR regexp_matches({_NAME}, '\\.(example|sample|template|dist)$') AS text_file, regexp_matches(p, '(^|/)(\\.[^/]+|node_modules|__pycache__|venv|env)/') AS pruned FROM (SELECT k, shape, list_extract(['src/', '.git/', 'node_modules/x/', './a/', 'venv/'], CAST(k % 5 AS INT) + 1) || ['README', 'a.py', 'b.PNG', 'install.now', 'x.dist', '.env', 'noend'][CAST(shape % 7 AS INT) + 1] AS p FROM shapes)", V.shapes)(
    lambda d: d.withColumn("p", F.concat(V._pick(("src/", ".git/", "node_modules/x/", "./a/", "venv/"), "k % 5"), V._pick(("README", "a.py", "b.PNG", "install.now", "x.dist", ".env", "noend"), "shape % 7"))).select("k", "shape", N.is_text_file(c("p")).alias("text_file"), N.is_pruned(c("p")).alias("pruned"))
)
q("str26_quoted", "SELECT DISTINCT url, regexp_replace(url, '([^A-Za-z0-9_])', '\\\\\\1', 'g') AS pattern, true AS hits FROM incidents")(lambda d: d.select("url", N.quoted(c("url")).alias("pattern")).distinct().withColumn("hits", F.expr("url rlike concat('^', pattern, '$')")))
q("j14_search_plan", "SELECT n_regionkey AS company_id, n_name AS dork, parser FROM nation, (VALUES ('code'), ('repo'), ('commit')) v(parser)", _by_table("nation"))(lambda d: N.search_plan(d.select(c("n_regionkey").alias("company_id"), c("n_name").alias("dork")), ["code", "repo", "commit"]))

# judgement: shapes as results of detectors
_DET = ("AWS", "company-api-keys-x", "Generic", "custom-rule", "URI", "GitHub")
_TERMS = ["acme", "zq", "standard"]
_RES = f"SELECT k, shape, t AS raw, [{', '.join(map(sql.text, _DET))}][CAST((k + shape) % 6 AS INT) + 1] AS rule, k % 11 = 0 AS verified, 'f' || k AS file, 'c' AS commit FROM shapes"


def _results(d):
    return d.select("k", "shape", c("t").alias("raw"), V._pick(_DET, "(k + shape) % 6").alias("rule"), (c("k") % 11 == 0).alias("verified"), F.concat(F.lit("f"), "k").alias("file"), F.lit("c").alias("commit"))


_REL = "least(1, " + " + ".join(f"(CASE WHEN contains(lower(concat_ws(' ', nullif(raw, ''), file, commit)), '{w}') THEN least({len(w)} / 10.0, 1) ELSE 0 END)" for w in _TERMS) + ")"
_CTX = f"((CASE WHEN verified THEN 1 ELSE 0 END) + (CASE WHEN {sql.any_in('lower(rule)', R.VALUED_DETECTORS)} THEN 0.5 ELSE 0 END) - 0.3 * (" + " + ".join(f"CAST(contains(lower(raw), '{w}') AS INT)" for w in R.TEST_WORDS) + "))"
_PAT = lambda t: "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in _TERMS if len(w) > 2) + ")"
q("cls06_cls07_scores", f", r AS ({_RES}) SELECT k, shape, round({_REL}::DOUBLE, 6) AS relevance, round({_CTX}::DOUBLE, 6) AS contextual FROM r", V.shapes)(
    lambda d: _results(d).select("k", "shape", F.round(T.relevance(F.concat_ws(" ", F.nullif("raw", F.lit("")), "file", "commit"), _TERMS), 6).alias("relevance"), F.round(N.contextual_score(c("rule"), c("raw"), c("verified")), 6).alias("contextual"))
)
q("cls09_judged", f", r AS ({_RES}) SELECT k, shape FROM r WHERE {_REL} > 0 OR {_CTX} >= 0 OR verified", V.shapes)(lambda d: N.judged(_results(d).withColumns({"repo": c("k"), "seq": c("shape")}), _TERMS).select("k", "shape"))
q(
    "cls05_meaningful",
    f""", r AS ({_RES}), s AS (SELECT *, {_REL} AS rel, {_CTX} AS ctx FROM r) SELECT k, shape, CASE WHEN verified OR {sql.any_in('lower(rule)', R.COMPANY_DETECTORS)} OR rel > 0.2 OR ctx > 0.3 OR {sql.any_in('lower(rule)', R.NOTED_DETECTORS)} THEN 1 WHEN raw = '' THEN 0
    WHEN {_PAT('raw')} THEN 1 WHEN length(raw) < 8 THEN 0 WHEN {sql.entropy('raw')} > 3.5 OR {sql.encoded('raw', 16, 20)} OR {_PAT('file')} THEN 1 ELSE 0 END AS meaningful FROM s""",
    V.shapes,
)(lambda d: _results(d).select("k", "shape", N.meaningful(c("rule"), c("raw"), c("verified"), T.relevance(F.concat_ws(" ", F.nullif("raw", F.lit("")), "file", "commit"), _TERMS), N.contextual_score(c("rule"), c("raw"), c("verified")), _TERMS, c("file")).alias("meaningful")))
q("cls08_company_pattern", f", r AS ({_RES}) SELECT k, shape, {_PAT('raw')} AS hit FROM r", V.shapes)(lambda d: _results(d).select("k", "shape", N.company_pattern(c("raw"), _TERMS).alias("hit")))
q("srt05_judged_order", f", r AS ({_RES}) SELECT k, shape, row_number() OVER (PARTITION BY k ORDER BY verified DESC, round({_REL}::DOUBLE, 6) DESC, round({_CTX}::DOUBLE, 6) DESC, shape) AS nth FROM r WHERE {_REL} > 0 OR {_CTX} >= 0 OR verified", V.shapes)(
    lambda d: D.numbered(N.weighed(_results(d).withColumns({"repo": c("k"), "seq": c("shape")}), _TERMS), ["k"], [F.desc("verified"), F.desc(F.round("relevance", 6)), F.desc(F.round("contextual", 6)), "shape"], "nth").select("k", "shape", (c("nth") + 1).cast("long").alias("nth"))
)
q("cls11_monitoring", f"SELECT id, CAST(NOT ({sql.one_of('dom', R.PUBLIC_DOMAINS)} OR {sql.any_in('dom', R.NOREPLY_MARKS)}) OR id % 4 = 0 AS INT) AS flag FROM (SELECT id, lower(trim(string_split(email, '@')[-1])) AS dom FROM committers)", V.committers)(lambda d: d.select("id", N.needs_monitoring(c("email"), F.when(c("id") % 4 == 0, "my-secret repo").otherwise("secretary"), c("name")).alias("flag")))
q("j12_added_committers", "SELECT repo, name, 0 AS need_monitor FROM committers UNION ALL SELECT DISTINCT m.repo, m.nation, 0 FROM committers m", V.committers)(
    lambda d: N.added_committers(d.select("repo", "name", "email", F.lit(0).alias("need_monitor")), d.select("repo", c("id").alias("seq"), F.concat("nation", F.lit("<"), "email").alias("email")).unionByName(d.select("repo", c("id").alias("seq"), F.concat("name", F.lit("<"), "email").alias("email")))).select("repo", "name", "need_monitor")
)
q("agg39_all_scripts", "SELECT repo, round(length(regexp_replace(description, '[^" + "".join(f"{a}-{b}" for a, b in R.FOREIGN_SCRIPTS) + "]', '', 'g')) / greatest(length(description), 1), 6) AS density, regexp_matches(description, '[Ѐ-ӿ]') AS cyrillic FROM candidates", V.candidates)(lambda d: d.select("repo", F.round(A.foreign_share(c("description")), 6).alias("density"), A.has_cyrillic(c("description")).alias("cyrillic")))
q("cls15_flags", "SELECT repo, size < 10 AS is_tiny, size < 100 AS is_small, stargazers_count >= 500 OR forks_count >= 100 OR contributors_count >= 20 AS is_popular, stargazers_count >= 5000 AS is_very_popular, date_diff('day', created_at::DATE, DATE '2024-06-01') > 2920 AS is_very_old FROM candidates", V.candidates)(
    lambda d: d.select("repo", *(v.alias(k) for k, v in A.shape_flags(c, F.lit("2024-06-01").cast("date")).items() if k != "is_personal"))
)
q("cls16_fork_penalty", "SELECT repo, CASE WHEN NOT fork THEN 0 WHEN commits_count > 100 AND forks_count < 100 THEN 0.2 ELSE 0.4 END::DOUBLE AS penalty FROM candidates", V.candidates)(lambda d: d.select("repo", A.fork_penalty(c("fork"), c("commits_count"), F.when(c("forks_count") < 100, 1).otherwise(2)).alias("penalty")))

# strings and documents
q("str09_semantic", "SELECT doc_id, line_no, regexp_matches(text, '(?i)\\b(license)[\\p{L}\\p{N}_.-]*') AND NOT regexp_matches(text, '(?i)[^a-zA-Z0-9\\s]+license[^a-zA-Z0-9\\s]+') AS hit FROM (SELECT file AS doc_id, line_no, text FROM repo_lines) WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')", V.repo_lines)(
    lambda d: d.where(c("text").rlike(r"^[\x00-\x7F]*$")).select(c("file").alias("doc_id"), "line_no", (T.semantic_check(c("text"), "license") == 1).alias("hit"))
)
q("str11_grep_context", "SELECT file, line_no, CASE WHEN length(text) <= 100 THEN text WHEN position('the' IN lower(text)) = 0 THEN left(text, 100) || '...' ELSE (CASE WHEN position('the' IN lower(text)) > 51 THEN '...' ELSE '' END) || substr(text, greatest(position('the' IN lower(text)) - 50, 1), least(position('the' IN lower(text)) + 53, length(text) + 1) - greatest(position('the' IN lower(text)) - 50, 1)) || (CASE WHEN position('the' IN lower(text)) + 53 <= length(text) THEN '...' ELSE '' END) END AS ctx FROM repo_lines", V.repo_lines)(
    lambda d: d.select("file", "line_no", T.context_around(c("text"), F.lit("the")).alias("ctx"))
)
_WS = "list_filter(string_split_regex(lower(p_name), '[\\s\\-_.,()&]+'), lambda w: w <> '')"
_LONG = f"list_filter({_WS}, lambda w: length(w) > 2)"
q("str25_terms", f"SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(list_concat([lower(p_name)], {_LONG}), [array_to_string(list_transform({_WS}, lambda w: left(w, 1)), ''), array_to_string(list_transform(list_filter({_LONG}, lambda w: w NOT IN ('the','and','of','for','in','on','at','to','a','an')), lambda w: left(w, 1)), '')]), lambda w: length(w) > 1))) AS t FROM part", _by_table("part"))(lambda d: d.select("p_partkey", T.company_terms(c("p_name")).alias("t")))
q("str34_dangerous", "SELECT doc_id, regexp_matches(text, '(?i)\\b(api_key|secret|password|token|credential|private_key|prod|production|admin|root|database|db_password)\\b') AS hit FROM documents", docs)(lambda d: d.select("doc_id", T.dangerous(c("text")).alias("hit")))
q("str35_scrubbed", "SELECT id, 'remote https://' || CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END || url AS t FROM (SELECT id, '.github.com/a' AS url FROM incidents)")(lambda d: d.select("id", T.scrubbed_remote(F.concat(F.lit("remote https://tok"), "id", F.lit("@"), F.when(c("id") % 2 == 0, "x").otherwise("y"), F.lit(".github.com/a"))).alias("t")))
q("str27_decoded", "SELECT doc_id, left(text, 200) AS t FROM documents", docs)(lambda d: d.select("doc_id", J.decoded_text(F.when(c("doc_id") % 2 == 0, F.encode(F.left("text", F.lit(200)), "UTF-8")).otherwise(F.when(F.left("text", F.lit(200)).rlike("^[\\x00-\\xff]*$") & F.left("text", F.lit(200)).rlike("[\\x80-\\xff]"), F.encode(F.left("text", F.lit(200)), "ISO-8859-1")).otherwise(F.encode(F.left("text", F.lit(200)), "UTF-8")))).alias("t")))
q("mth02_relevance", "SELECT doc_id, round(least(1, (CASE WHEN contains(lower(text), 'license') THEN 0.7 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 0.3 ELSE 0 END) + (CASE WHEN contains(lower(text), 'une') THEN 0.3 ELSE 0 END))::DOUBLE, 6) AS r FROM documents", docs)(lambda d: d.select("doc_id", F.round(T.relevance(c("text"), F.array(F.lit("License"), F.lit("the"), F.lit("une"))), 6).alias("r")))
_doc = lambda d: d.select("id", F.to_json(F.struct(F.struct(c("level").alias("totalCount")).alias("stars"), F.array("url", "leak_type").alias("tags"), c("result").alias("n"))).alias("j"))
q("json01_nested", "SELECT id, level AS stars, 2 AS tags, result AS n, -1 AS missing FROM incidents")(
    lambda d: _doc(d).withColumn("v", F.parse_json("j")).select("id", J.nested(c("v"), "$.stars.totalCount", "int", 0).alias("stars"), J.count_of(F.try_variant_get("v", "$.tags", "variant")).alias("tags"), J.count_of(F.try_variant_get("v", "$.n", "variant")).alias("n"), J.nested(c("v"), "$.nope.x", "int", -1).alias("missing"))
)
q("json06_llm", "SELECT id, level >= 2 AS related, level / 4.0::DOUBLE AS confidence, CASE WHEN level = 0 THEN 'unknown' ELSE 'high' END AS severity FROM incidents")(
    lambda d: d.select("id", F.concat(F.when(c("id") % 2 == 0, "```json\n").otherwise("Here it is: "), F.lit('{"company_relevance": {"is_related": '), (c("level") >= 2).cast("string"), F.lit(', "confidence": '), (c("level") / 4).cast("string"), F.lit("}"), F.when(c("level") > 0, ', "severity_assessment": {"level": "high"}').otherwise(""), F.lit("}"), F.when(c("id") % 2 == 0, "\n```").otherwise(" as asked.")).alias("t"))
    .select("id", J.verdict_document(J.llm_json(c("t"))).alias("v")).select("id", c("v.company_relevance.is_related").alias("related"), c("v.company_relevance.confidence").alias("confidence"), c("v.severity_assessment.level").alias("severity"))
)
q("json05_first_filled", "SELECT id, CASE WHEN level = 0 THEN url WHEN level = 1 THEN leak_type ELSE 'z' END AS m FROM incidents")(lambda d: d.select("id", J.first_filled(F.when(c("level") == 0, c("url")).otherwise(""), F.when(c("level") == 1, c("leak_type")), F.lit("z")).alias("m")))
q("json08_trimmed", "SELECT doc_id, left(text, 400) AS t, length(text) > 400 AS cut FROM documents", docs)(lambda d: d.select("doc_id", J.trimmed(c("text"), 100).alias("t"), (F.length("text") > 400).alias("cut")))
q("json09_says", "SELECT id, level >= 2 AS large FROM incidents")(lambda d: d.select("id", J.says(F.parse_json(F.when(c("level") >= 2, '{"a": [{"b": "Repo is TOO large"}]}').otherwise('{"too": "large"}')), ["too large"]).alias("large")))
q("json10_defaults", "SELECT id, CASE WHEN id % 2 = 0 THEN level ELSE 0 END AS size, CASE WHEN id % 3 = 0 THEN leak_type ELSE '_' END AS description FROM incidents")(lambda d: J.with_defaults(d.select("id", F.when(c("id") % 2 == 0, c("level")).alias("size"), F.when(c("id") % 3 == 0, c("leak_type")).alias("description"))))
q("snk10_encoded", "SELECT id, url AS back FROM incidents")(lambda d: d.select("id", F.try_variant_get(J.decoded_blob(J.encoded_blob(F.struct("url"))), "$.url", "string").alias("back")))
q("src30_decoded", "SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE level END AS level FROM incidents")(
    lambda d: d.select("id", J.encoded_blob(F.struct("level")).alias("b"), F.to_json(F.struct("level")).alias("p")).select("id", F.try_variant_get(J.decoded_blob(F.when(c("id") % 4 == 0, c("b")).when(c("id") % 4 == 1, c("p")).when(c("id") % 4 == 2, F.concat(F.lit("b'"), "b", F.lit("'"))).otherwise("junk{")), "$.level", "int").alias("level"))
)

# committers in order: a name or address that is known already doesn't count
_STEP = "o AS (SELECT repo, {n} AS name, {e} AS email, id AS seq, row_number() OVER (PARTITION BY repo ORDER BY id) AS i FROM committers), r AS (SELECT repo, i, seq, [name] AS ns, [email] AS ms, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.repo, o.i, o.seq, CASE WHEN list_contains(ns, name) OR list_contains(ms, email) THEN ns ELSE list_append(ns, name) END, CASE WHEN list_contains(ns, name) OR list_contains(ms, email) THEN ms ELSE list_append(ms, email) END, NOT (list_contains(ns, name) OR list_contains(ms, email)) FROM r JOIN o ON o.repo = r.repo AND o.i = r.i + 1)"
_RECURSIVE = ORACLE_VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + ", "
ORACLE_SQL["ded05_committers"] = _RECURSIVE + _STEP.format(n="name", e="email") + " SELECT o.repo, o.name, o.email, o.seq FROM o JOIN r USING (repo, i) WHERE keep"
q("ded05_ordered", None, V.committers)(lambda d: committers_first_seen(d.select("repo", F.concat(F.lit("n"), c("id") * 3 % 7).alias("name"), F.concat(F.lit("e"), c("id") % 11).alias("email"), c("id").alias("seq"))))
ORACLE_SQL["ded05_ordered"] = _RECURSIVE + _STEP.format(n="'n' || (id * 3 % 7)", e="'e' || (id % 11)") + " SELECT o.repo, o.name, o.email, o.seq FROM o JOIN r USING (repo, i) WHERE keep"

# captures of scanners, as they write them, one for each repository
_s = F.struct
_whole = lambda d, x: d.groupBy("repo").agg(F.collect_list(x).alias("x")).select(F.to_json("x").alias("value"))
q("src23_gitleaks", "SELECT 'gitleaks' AS scanner, path AS file, match, 'V:' || (seq % 7) || '-' || (seq % 7 + 1) || ';H:1-2;' AS position, rule FROM repo_findings WHERE match <> ''", V.repo_findings)(
    lambda d: C.gitleaks_rows(_whole(d, _s((c("seq") % 7).alias("StartLine"), (c("seq") % 7 + 1).alias("EndLine"), F.lit(1).alias("StartColumn"), F.lit(2).alias("EndColumn"), F.when(c("seq") % 2 == 0, c("match")).otherwise("").alias("Match"), c("match").alias("Secret"), c("path").alias("File"), c("rule").alias("RuleID"))))
)
q("src24_git_secrets", "SELECT 'gitsecrets' AS scanner, 'f' || file AS file, trim(match) AS match, CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) END AS position, CAST(NULL AS VARCHAR) AS rule FROM findings WHERE length(trim(match)) >= 3 AND (seq % 2 = 0 OR NOT contains(match, ':'))", V.findings)(
    lambda d: C.git_secrets_rows(d.where("seq % 2 = 0 or not contains(match, ':')").select(F.concat_ws(":", F.concat(F.lit("f"), "file"), F.when(c("seq") % 2 == 0, c("seq")).cast("string"), "match").alias("value")).unionByName(d.select(F.lit("Usage: git-secrets").alias("value"))))
)
q("src25_detect_secrets", "SELECT 'detect_secrets' AS scanner, CAST(f.file AS VARCHAR) AS file, r.text AS match, CAST(f.seq AS VARCHAR) AS position, f.rule, f.seq % 2 = 0 AS verified FROM findings f LEFT JOIN (SELECT CAST(file AS VARCHAR) AS file, line_no, text FROM repo_lines) r ON r.file = CAST(f.file AS VARCHAR) AND r.line_no = f.seq", tables("findings", "repo_lines"))(
    lambda t: C.detect_secrets_rows(t[0].groupBy("file").agg(F.collect_list(_s(c("rule").alias("type"), c("seq").alias("line_number"), (c("seq") % 2 == 0).alias("is_verified"))).alias("x")).select(F.to_json(_s(F.create_map(c("file").cast("string"), "x").alias("results"))).alias("value")), t[1].select(c("file").cast("string").alias("file"), "line_no", "text"))
)
q("src26_kingfisher", "SELECT 'kingfisher' AS scanner, path AS file, match, CAST(CAST(seq % 9 AS INT) AS VARCHAR) AS position, rule FROM repo_findings", V.repo_findings)(
    lambda d: C.kingfisher_rows(d.groupBy("repo", "rule").agg(F.collect_list(_s(_s(c("path").alias("path"), (c("seq") % 9).alias("line"), c("match").alias("snippet")).alias("finding"))).alias("matches")).groupBy("repo").agg(F.collect_list(_s(c("rule").alias("id"), "matches")).alias("findings_by_rule")).select(F.to_json(_s("findings_by_rule")).alias("value")).unionByName(d.select(F.lit("a line of its log").alias("value"))))
)
q("src27_deepsecrets", "SELECT 'deepsecrets' AS scanner, CAST(file AS VARCHAR) AS file, left(match, 100) AS match FROM findings QUALIFY row_number() OVER (PARTITION BY file, left(match, 100) ORDER BY rule, seq) = 1", V.findings)(
    lambda d: C.deepsecrets_rows(d.groupBy("file").agg(F.array_sort(F.collect_list(_s("rule", "seq", c("match").alias("line")))).alias("x")).select(c("file").cast("string").alias("capture"), F.to_json(F.create_map(c("file").cast("string"), F.transform("x", lambda x: _s(x["line"].alias("line"))))).alias("value"))).select("scanner", "file", "match")
)
q("src28_trufflehog", "SELECT 'trufflehog' AS scanner, path AS file, match, 'c' || repo AS position, rule, seq % 2 = 0 AS verified FROM repo_findings", V.repo_findings)(
    lambda d: C.trufflehog_rows(d.groupBy("repo").agg(F.array_join(F.collect_list(F.to_json(_s(c("rule").alias("DetectorName"), (c("seq") % 2 == 0).alias("Verified"), c("match").alias("RawV2"), F.lit("}{ in a string").alias("Raw"), _s(_s(_s(c("path").alias("file"), F.concat(F.lit("c"), "repo").alias("commit")).alias("Git")).alias("Data")).alias("SourceMetadata")))), "").alias("value")))
)
q("src08_url_list", "SELECT url FROM incidents WHERE contains(url, 'github.com')")(lambda d: C.url_rows(d.select(F.concat(F.lit(" "), "url", F.lit("  ")).alias("value")).unionByName(d.select(F.concat(F.lit("//"), "url").alias("value")))))
