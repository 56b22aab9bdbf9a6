"""Deterministic views of the driver tables, for Spark; ORACLE_VIEWS are the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = {"signup": "api_key in signup", "error": "debug log trace", "purchase": "database password", "click": "private rsa block"}
    kind = F.lit(None).cast("string")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    sites = F.array(*map(F.lit, ("github.com", "gitlab.com", "bitbucket.org", "example.org")))
    url = F.concat(F.lit("https://"), F.get(sites, (F.col("event_id") % 4).cast("int")), F.lit("/org"), F.col("user_id") % 20, F.lit("/repo"), F.col("event_id") % 97)
    return e.select(F.col("event_id").alias("id"), url.alias("url"), F.least(F.lit(3), F.floor(F.col("value") / 50)).cast("int").alias("level"), F.col("ts").alias("found_at"), F.coalesce(kind, F.lit("misc")).alias("leak_type"), (F.col("event_id") % 6).cast("int").alias("result"), (F.col("user_id") % 20).alias("company_id"))


def repo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of simple rules over whole texts: repo, file, rule, seq, match."""
    d = table(spark, sf_dir, "documents")
    # each rule with a cheap pattern that no text without a match passes
    rules = {"assign": (r"([A-Za-z_]+ ?= ?\"?[0-9a-f]{12,})", r"= ?\"?[0-9a-f]{12}"), "email": (r"([A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z])", "@"), "ipv4": (r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", r"[0-9]\.[0-9]"), "licence": (r"(License[d]?|Copyright)", "License|Copyright")}
    none = F.array().cast("array<string>")
    per = F.array(*(F.struct(F.lit(k).alias("rule"), F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(p), F.lit(1))).otherwise(none).alias("m")) for k, (p, hint) in rules.items()))
    flat = d.select(F.col("source").alias("repo"), F.col("doc_id").alias("file"), F.explode(per).alias("r")).where(F.size("r.m") > 0)
    return flat.select("repo", "file", "r.rule", F.posexplode("r.m").alias("seq", "match"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def committers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    domains = F.array(*map(F.lit, ("gmail.com", "acme.com", "users.noreply.github.com", "mail.ru", "corp.example")))
    mail = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@"), F.get(domains, (F.col("c_custkey") % 5).cast("int")))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37).alias("repo"), F.lower("c_name").alias("name"), mail.alias("email"), F.col("n_name").alias("nation"))


#: Path templates of repo_findings, by file.
PATHS = ("src/app.py", "config/prod.env", "tests/unit/a.js", "logo.png", "README.md", "com/acme/customer/secrets.properties", "lib/django/settings.py", "deploy/mail-auth.yaml", "example/x.py", ".env.sample", "src\\live\\db.cfg")
RANKS = ("gitsecrets", "trufflehog", "grepscan", "deepsecrets", "gitleaks", "kingfisher", "detect_secrets")


def _pick(values: tuple, at: str):
    return F.get(F.array(*map(F.lit, values)), F.expr(at).cast("int"))


def repo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings as those of 37 repositories: repo, scanner, seq, rule, match, path, meaningful."""
    d = findings(spark, sf_dir)
    return d.select((F.col("file") % 37).alias("repo"), _pick(RANKS, "(file + seq) % 7").alias("scanner"), F.expr("(file * 4 + case rule when 'assign' then 0 when 'email' then 1 when 'ipv4' then 2 else 3 end) * 1000000 + seq").alias("seq"), "rule", "match", _pick(PATHS, f"(file + seq) % {len(PATHS)}").alias("path"), (F.col("seq") % 5 != 4).cast("int").alias("meaningful"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository for each value of c_custkey % 37."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy((F.col("c_custkey") % 37).alias("repo")).agg(F.min("n_name").alias("nation"), F.max("c_mktsegment").alias("segment"), F.max("c_acctbal").alias("hi"), F.min("c_acctbal").alias("lo"), F.count("*").alias("n"))
    whole = lambda e: F.expr(f"cast(floor({e}) as int)")
    return g.select(
        "repo",
        F.concat(F.lower("nation"), F.lit("-"), _pick(("acme-service", "learn-python", "mailer", "customer-portal"), "repo % 4")).alias("repo_name"),
        _pick(("acme team", "Иван Петров", "J. Doe", "", "customer bot"), "repo % 5").alias("author_name"),
        _pick(("acme", "mail", "Customer", "api portal"), "repo % 4").alias("dork"),
        _pick(("Acme Corp", "Mail Group", "Customer & Co", "Demo Labs"), "floor(repo / 4) % 4").alias("company_name"),
        F.concat(F.lower("nation"), _pick((" acme mirror", " 中文说明 文档", " Почта customer", ""), "repo % 4")).alias("description"),
        F.concat(F.lit("api,"), F.lower("segment")).alias("topics"),
        (F.abs(whole("hi")) % 300).alias("size"),
        whole("greatest(hi, 0)").alias("stargazers_count"),
        (F.abs(whole("lo")) % 150).alias("forks_count"),
        (F.col("n") % 25).cast("int").alias("contributors_count"),
        (F.abs(whole("hi")) % 200).alias("commits_count"),
        (F.col("repo") % 3 == 0).alias("fork"),
        F.expr("timestamp_ntz '2012-01-01 00:00:00' + make_dt_interval(cast(repo * 150 as int))").alias("created_at"),
        F.when(F.col("repo") % 2 == 0, "ru").otherwise("en").alias("country"),
        F.when(F.col("repo") % 3 == 0, F.lit(None)).otherwise(F.col("repo") % 3 == 1).alias("ai_related"),
        (F.col("repo") % 10 / 10.0).alias("ai_confidence"),
        (F.col("repo") % 8 / 8.0).alias("ai_tp"),
        (F.col("repo") % 4 / 4.0).alias("ai_severity"),
    )


#: Shapes of strings, by part, over the SQL of both engines: a is md5 of the key, b the part's type, n its name.
SHAPES = (
    "a", "left(a, 12)", "upper(concat('AKIA', substr(upper(a), 1, 16)))", "concat('ghp_', a, left(a, 4))", "concat('your_', replace(b, ' ', '_'))", "concat(replace(lower(n), ' ', '-'), '_here')", "concat('<', n, '>')", "concat('[', b, ']')",
    "repeat(left(a, 4), 6)", "repeat('x', cast(k % 9 as int))", "concat(left(a, 8), '-', substr(a, 9, 4), '-', substr(a, 13, 4), '-', substr(a, 17, 4), '-', substr(a, 21, 12))", "concat('eyJ', a, '.', a, '.', left(a, 12))", "concat(b, ' ', n)", "lower(b)",
    "concat('http://localhost:8080/', left(a, 6))", "concat('db.', left(a, 5), '.example.com')", "'changeme'", "'abcdefg'", "'aab111c'", "concat('ACMEtoken', upper(left(a, 9)), lower(b), 'Zq', left(a, 9))",
    "concat(upper(left(a, 13)), substr(a, 14, 19), '=')", "concat('AKIAIOSFODNN7', 'EXAMPLE')", "'password123'", "concat('k', left(a, 3), '_acme9_', a)", "concat('-----BEGIN RSA PRIVATE KEY-----', a, '-----END RSA PRIVATE KEY-----')", "concat('test_', left(a, 10), '_key')", "concat('learn-', lower(n))",
    "concat('user:', a, '@acme.com')", "''", "concat('  ', a, '  ')",
)


#: Tasks that parts are dealt out to for each core: a file of one row group is one task, and a part's strings are much work.
TASKS_A_CORE = 4


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t: a string of each shape for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "p_partkey")
    p = p.selectExpr("p_partkey AS k", "md5(cast(p_partkey AS string)) AS a", "p_type AS b", "p_name AS n")
    return p.select("k", F.posexplode(F.array(*(F.expr(x) for x in SHAPES))).alias("shape", "t"))


#: CTEs that the oracle queries begin with.
ORACLE_VIEWS = r"""
WITH incidents AS (SELECT event_id AS id,
    'https://' || ['github.com','gitlab.com','bitbucket.org','example.org'][CAST(event_id % 4 AS INT) + 1] || '/org' || (user_id % 20) || '/repo' || (event_id % 97) AS url,
    CAST(least(3, floor(value / 50)) AS INT) AS level, ts AS found_at,
    CASE event_type WHEN 'signup' THEN 'api_key in signup' WHEN 'error' THEN 'debug log trace' WHEN 'purchase' THEN 'database password' WHEN 'click' THEN 'private rsa block' ELSE 'misc' END AS leak_type,
    CAST(event_id % 6 AS INT) AS result, user_id % 20 AS company_id FROM events),
repo_lines AS (SELECT source AS repo, doc_id AS file, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents),
found AS (SELECT source AS repo, doc_id AS file, k.rule, CASE k.rule WHEN 'assign' THEN regexp_extract_all(text, '[A-Za-z_]+ ?= ?"?[0-9a-f]{12,}')
    WHEN 'email' THEN regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]') WHEN 'ipv4' THEN regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')
    ELSE regexp_extract_all(text, 'License[d]?|Copyright') END AS m FROM documents, (VALUES ('assign'), ('email'), ('ipv4'), ('licence')) k(rule)),
findings AS (SELECT repo, file, rule, generate_subscripts(m, 1) - 1 AS seq, unnest(m) AS match FROM found),
committers AS (SELECT c_custkey AS id, c_custkey % 37 AS repo, lower(c_name) AS name,
    lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@' || ['gmail.com','acme.com','users.noreply.github.com','mail.ru','corp.example'][CAST(c_custkey % 5 AS INT) + 1] AS email, n_name AS nation
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
repo_findings AS (SELECT file % 37 AS repo, ['gitsecrets','trufflehog','grepscan','deepsecrets','gitleaks','kingfisher','detect_secrets'][CAST((file + seq) % 7 AS INT) + 1] AS scanner, (file * 4 + CASE rule WHEN 'assign' THEN 0 WHEN 'email' THEN 1 WHEN 'ipv4' THEN 2 ELSE 3 END) * 1000000 + seq AS seq, rule, match,
    [__PATHS__][CAST((file + seq) % __N__ AS INT) + 1] AS path, CAST(seq % 5 <> 4 AS INT) AS meaningful FROM findings),
cand0 AS (SELECT c_custkey % 37 AS repo, min(n_name) AS nation, max(c_mktsegment) AS segment, max(c_acctbal) AS hi, min(c_acctbal) AS lo, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
candidates AS (SELECT repo, lower(nation) || '-' || ['acme-service','learn-python','mailer','customer-portal'][CAST(repo % 4 AS INT) + 1] AS repo_name,
    ['acme team','Иван Петров','J. Doe','','customer bot'][CAST(repo % 5 AS INT) + 1] AS author_name, ['acme','mail','Customer','api portal'][CAST(repo % 4 AS INT) + 1] AS dork,
    ['Acme Corp','Mail Group','Customer & Co','Demo Labs'][CAST((repo // 4) % 4 AS INT) + 1] AS company_name, lower(nation) || [' acme mirror',' 中文说明 文档',' Почта customer',''][CAST(repo % 4 AS INT) + 1] AS description,
    'api,' || lower(segment) AS topics, abs(CAST(floor(hi) AS INT)) % 300 AS size, CAST(floor(greatest(hi, 0)) AS INT) AS stargazers_count, abs(CAST(floor(lo) AS INT)) % 150 AS forks_count, CAST(n % 25 AS INT) AS contributors_count,
    abs(CAST(floor(hi) AS INT)) % 200 AS commits_count, repo % 3 = 0 AS fork, TIMESTAMP '2012-01-01' + to_days(CAST(repo * 150 AS INT)) AS created_at, CASE WHEN repo % 2 = 0 THEN 'ru' ELSE 'en' END AS country,
    CASE WHEN repo % 3 = 0 THEN NULL ELSE repo % 3 = 1 END AS ai_related, (repo % 10) / 10.0::DOUBLE AS ai_confidence, (repo % 8) / 8.0::DOUBLE AS ai_tp, (repo % 4) / 4.0::DOUBLE AS ai_severity FROM cand0),
shape0 AS (SELECT p_partkey AS k, md5(CAST(p_partkey AS VARCHAR)) AS a, p_type AS b, p_name AS n FROM part),
shape1 AS (SELECT k, [__SHAPES__] AS ts FROM shape0),
shapes AS (SELECT k, CAST(generate_subscripts(ts, 1) - 1 AS INT) AS shape, unnest(ts) AS t FROM shape1)
""".replace("__PATHS__", ", ".join(f"'{p}'" for p in PATHS)).replace("__N__", str(len(PATHS))).replace("__SHAPES__", ", ".join(SHAPES))
