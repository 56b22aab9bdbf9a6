"""From scanners' raw results to one normalised, judged and de-duplicated table of findings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import rules as R
from leakloom.functions import text as T
from leakloom.operators import ranking
from leakloom.operators.tables import capped, numbered

#: Columns of scanners that a stored finding drops; results a scanner keeps in a repository; characters shown.
NOISE = """Fingerprint StartLine EndLine StartColumn EndColumn SymlinkFile Secret Entropy Message SourceID SourceType SourceName
DetectorType DecoderName Redacted ExtraData StructuredData Raw RawV2""".split()
KEPT, SHOWN = 200, 100
#: Lines of a file, and lines of a repository after which its search ends.
LINES_A_FILE, LINES_ENOUGH = 50, 400


def fan_in(captures: list[DataFrame]) -> DataFrame:
    """Findings of all scanners in one table; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), captures)


def cleaned(df: DataFrame) -> DataFrame:
    return df.drop(*NOISE)


def standard(match: Column, file: Column | None = None, **extra: Column) -> Column:
    """struct<match, file, extra columns> of one finding; no file is an empty one."""
    return F.struct(match.alias("match"), (F.lit("") if file is None else file).alias("file"), *(v.alias(k) for k, v in extra.items()))


def normalised(raw: DataFrame, cap: int = KEPT) -> DataFrame:
    """raw(repo, scanner, seq, match, file, ...) -> the same, numbered by leak_no within repo and scanner.

    A scanner's first ``cap`` results count; of those, the first of each (match, file); long matches are cut after all
    comparisons. A missing file is an empty one."""
    by = ["repo", "scanner"]
    first = ranking.capped(raw.withColumn("file", F.coalesce("file", F.lit(""))), by, ["seq"], cap)
    others = [c for c in first.columns if c not in (*by, "match", "file")]
    once = first.groupBy(*by, "match", "file").agg(F.min_by(F.struct(*others), "seq").alias("r")).select(*by, "match", "file", "r.*")
    # no key has more than ``cap`` rows by now
    return numbered(once, by, ["seq"]).withColumn("match", T.truncated(F.col("match"), SHOWN)).select(*raw.columns, "leak_no")


def messages(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """repo, message for repos(repo, dork) that no scanner found anything in."""
    text = F.concat(F.lit('No leaks found for dork "'), "dork", F.lit('" in repository'))
    return repos.join(findings.select("repo").distinct(), "repo", "left_anti").select("repo", text.alias("message"))


def unified(findings: DataFrame) -> DataFrame:
    """The first finding of each text (50 characters, whatever the case) of a repository, scanners in their order."""
    text = F.trim("match")
    rank = F.array_position(F.array(*map(F.lit, R.SCANNERS)), F.col("scanner"))
    rows = findings.withColumn("match", text).where((F.coalesce("match", F.lit("")) != "") & ~F.col("match").isin("...") & (rank > 0))
    rows = rows.where("rule is null or rule <> 'Info'") if "rule" in rows.columns else rows
    names = [c for c in rows.columns if c != "repo"]
    return rows.groupBy("repo", F.left(F.lower("match"), F.lit(50)).alias("__k")).agg(F.min_by(F.struct(*names), F.struct(rank, "seq")).alias("r")).select("repo", "r.*")


def in_order(lines: Column) -> Column:
    """Distinct lines in the order of their first appearance."""
    return F.array_distinct(lines)


def is_text_file(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    known = name.isin(R.TEXT_NAMES) | name.rlike(r"^(license|changelog|install)\.") | name.rlike(r"\.(example|sample|template|dist)$")
    return F.coalesce(name.rlike(r"^.+\.(" + "|".join(R.TEXT_ENDINGS) + ")$") | known, F.lit(False))


def is_pruned(path: Column) -> Column:
    """Whether a folder of the path is hidden or holds installed packages."""
    folders = F.split(F.regexp_replace(path, r"[^/\\]*$", ""), r"[/\\]")
    return F.coalesce(F.exists(folders, lambda x: (x.startswith(".") & (x != ".")) | x.isin("node_modules", "__pycache__", "venv", "env")), F.lit(False))


def term_pattern(terms: list[str]) -> str:
    """A pattern that finds any of the terms as a word, whatever the case."""
    return rf"(?iU)\b{T.one_of(terms)}\b"


def quoted(t: Column) -> Column:
    """The text as a pattern that matches just it."""
    return F.regexp_replace(t, r"([^A-Za-z0-9_])", r"\\$1")


def searched(lines: DataFrame, terms: list[str]) -> DataFrame:
    """lines(repo, file, line_no, text) -> those with a term: also term, context. A file gives its first LINES_A_FILE hits; a
    repository with LINES_ENOUGH or more gives its first KEPT, files in order. The caps are what the search means."""
    p = term_pattern(terms)
    text = F.trim("text")
    hits = lines.where(F.length(text).between(1, 1000) & text.rlike(p)).withColumn("term", F.regexp_extract(text, p, 0))
    hits = hits.withColumn("context", T.context_around(text, F.col("term")))
    hits = capped(hits, ["repo", "file"], ["line_no"], LINES_A_FILE)
    many = hits.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") >= LINES_ENOUGH).select("repo")
    return hits.join(many, "repo", "left_anti").unionByName(ranking.capped(hits.join(many, "repo", "left_semi"), ["repo"], ["file", "line_no"], KEPT))


def search_plan(targets: DataFrame, parsers: list[str]) -> DataFrame:
    """company_id, dork, parser: every search to run. Dorks are few (at most a hundred a company), parsers fewer."""
    return targets.select("company_id", "dork", F.explode(F.array(*map(F.lit, parsers))).alias("parser"))


def company_pattern(t: Column, terms: Column | list[str]) -> Column:
    """Whether a term of three letters or more is in the text; with digits behind it or in an address it is in it too."""
    low = F.lower(t)
    if not isinstance(terms, Column):
        long = [w for w in terms if len(w) >= 3]
        return F.coalesce(T.holds(low, long), F.lit(False)) if long else F.lit(False)
    return F.coalesce(F.exists(terms, lambda w: (F.length(w) >= 3) & F.contains(low, w)), F.lit(False))


def contextual_score(detector: Column, raw: Column, verified: Column) -> Column:
    """Up for verified results and detectors of valued services, down for each word of test data."""
    plus = F.when(F.coalesce(verified, F.lit(False)), 1.0).otherwise(0.0) + F.when(T.contains_any(detector, R.VALUED_DETECTORS), 0.5).otherwise(0.0)
    return plus - 0.3 * sum((F.contains(F.lower(raw), F.lit(w)).cast("int") for w in R.TEST_WORDS[1:]), F.contains(F.lower(raw), F.lit(R.TEST_WORDS[0])).cast("int"))


def weighed(results: DataFrame, terms: Column | list[str]) -> DataFrame:
    """trufflehog results (repo, rule, raw, file, commit, verified, ...) with relevance and contextual; those kept that are
    verified, relevant or not against all odds."""
    raw, verified = F.coalesce("raw", F.lit("")), F.coalesce("verified", F.lit(False))
    text = F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif("file", F.lit("")), F.nullif("commit", F.lit("")))
    contextual = contextual_score(F.col("rule"), raw, F.col("verified"))
    if isinstance(terms, Column):
        relevant = T.relevance(text, terms) > 0
    else:  # any term that isn't empty adds to the relevance; Java compiles no method of 8,000 bytes, so the filter is to be short
        relevant = reduce(or_, (F.contains(F.lower(text), F.lower(F.lit(w))) for w in terms if w), F.lit(False))
    return results.where(verified | (contextual >= 0) | relevant).withColumns({"relevance": T.relevance(text, terms), "contextual": contextual})


def judged(results: DataFrame, terms: Column | list[str]) -> DataFrame:
    """weighed results, best first, in their order where equal (seq)."""
    return weighed(results, terms).orderBy("repo", F.desc(F.coalesce("verified", F.lit(False))), F.desc("relevance"), F.desc("contextual"), "seq")


def meaningful(detector: Column, raw: Column, verified: Column, relevance: Column, contextual: Column, terms: Column | list[str], metadata: Column) -> Column:
    """1 for a result that says something, else 0: the first test that decides. Tests that agree stand by their cost, so that few rows
    come to the entropy, the dearest; no text of fewer than 12 different characters has more than 3.5 bits."""
    known = F.coalesce(verified, F.lit(False)) | T.contains_any(detector, R.COMPANY_DETECTORS) | T.contains_any(detector, R.NOTED_DETECTORS)
    scored = (F.coalesce(contextual, F.lit(0.0)) > 0.3) | (F.coalesce(relevance, F.lit(0.0)) > 0.2)
    r = F.coalesce(raw, F.lit(""))
    return F.when(known, 1).when(scored, 1).when(r == "", 0).when(company_pattern(r, terms), 1).when(F.length(r) < 8, 0).when(company_pattern(metadata, terms) | T.looks_like_encoded(r, 16, 20) | ((F.length(r) >= 12) & (T.entropy(r) > 3.5)), 1).otherwise(0)


def needs_monitoring(email: Column, repo_name: Column, name: Column) -> Column:
    """1 for a company address or a word of secrets in the repository's or the committer's name."""
    return (P.is_corporate(email) | T.dangerous(F.concat_ws(" ", repo_name, F.coalesce(name, F.lit(""))))).cast("int")


def added_committers(known: DataFrame, findings: DataFrame) -> DataFrame:
    """known(repo, name, email, need_monitor) and the authors of commits that findings(repo, seq, email as 'name<address>') name,
    where the repository has nobody of that name; the first address of a name stays."""
    parts = F.split("email", "<")
    rows = findings.where(F.size(parts) > 1).select("repo", "seq", F.get(parts, 0).alias("name"), F.get(parts, 1).alias("email"))
    first = rows.groupBy("repo", "name").agg(F.min_by("email", "seq").alias("email"))
    return known.unionByName(first.join(known.select("repo", "name").distinct(), ["repo", "name"], "left_anti").withColumn("need_monitor", F.lit(0)))


def findings_count(findings: DataFrame) -> DataFrame:
    """By repo: findings that aren't marked meaningless."""
    return findings.groupBy("repo").agg(F.count_if(F.coalesce(F.col("meaningful").cast("int"), F.lit(1)) != 0).alias("n"))


def scanner_hits(findings: DataFrame) -> DataFrame:
    """repo, scanner, hits, and a row of scanner null with the repository's total."""
    return findings.groupBy("repo", "scanner").agg(F.count("*").alias("hits")).unionByName(findings.groupBy("repo").agg(F.lit(None).cast("string").alias("scanner"), F.count("*").alias("hits")))

