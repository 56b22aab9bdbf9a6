"""Scanner and list captures as typed findings: scanner, file, match, position, rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions.documents import first_filled
from leakloom.functions.paths import valid_listed_url
from leakloom.operators.tables import first_seen


def gitleaks(spark: SparkSession, path: str) -> DataFrame:
    return gitleaks_rows(spark.read.text(path, wholetext=True))


_GITLEAKS = "struct<StartLine: int, EndLine: int, StartColumn: int, EndColumn: int, Match: string, Secret: string, File: string, RuleID: string>"


def gitleaks_records(records: DataFrame) -> DataFrame:
    """Findings of records(json, broken) of sources.split_json, for captures of any size; broken records have none."""
    return _gitleaks(records.where("not broken").select(F.from_json("json", _GITLEAKS).alias("f")).select("f.*"))


def gitleaks_rows(captures: DataFrame) -> DataFrame:
    """Findings of captures(value), each one JSON array; a broken one has none."""
    return _gitleaks(captures.select(F.explode(F.from_json("value", f"array<{_GITLEAKS}>")).alias("f")).select("f.*"))


def _gitleaks(df: DataFrame) -> DataFrame:
    at = F.concat(F.lit("V:"), "StartLine", F.lit("-"), "EndLine", F.lit(";H:"), "StartColumn", F.lit("-"), "EndColumn", F.lit(";"))
    return df.select(F.lit("gitleaks").alias("scanner"), F.col("File").alias("file"), first_filled(F.col("Match"), F.col("Secret")).alias("match"), at.alias("position"), F.col("RuleID").alias("rule"))


def objects(line: Column) -> Column:
    """The JSON objects of a line that holds several: it is split at each }{ outside of strings."""
    strings = r'"(?:[^"\\]|\\.)*"'
    # strings are passed over whole, so that what is split at is outside of them
    return F.split(F.regexp_replace(line, "(" + strings + r")|(\})\s*(?=\{)", "$1$2\u0001"), "(?<=[}])\u0001")


def trufflehog(spark: SparkSession, path: str) -> DataFrame:
    return trufflehog_rows(spark.read.text(path))


def trufflehog_rows(lines: DataFrame) -> DataFrame:
    """JSON objects of lines(value), also several run together in a line; broken ones are skipped."""
    lines = lines.select(F.explode(objects(F.col("value"))).alias("j")).withColumn("j", F.replace("j", F.lit("\u0001"), F.lit("")))
    v = F.try_parse_json("j")
    get = lambda p: F.try_variant_get(v, p, "string")
    out = lines.select(F.lit("trufflehog").alias("scanner"), get("$.SourceMetadata.Data.Git.file").alias("file"), first_filled(get("$.RawV2"), get("$.Raw")).alias("match"), get("$.SourceMetadata.Data.Git.commit").alias("position"), get("$.DetectorName").alias("rule"), F.coalesce(F.try_variant_get(v, "$.Verified", "boolean"), F.lit(False)).alias("verified"))
    return out.where("match is not null")


def kingfisher(spark: SparkSession, path: str) -> DataFrame:
    return kingfisher_rows(spark.read.text(path))


def kingfisher_rows(lines: DataFrame) -> DataFrame:
    """Findings of lines(value) that begin with a brace, by rule."""
    schema = "findings_by_rule array<struct<id: string, matches: array<struct<finding: struct<path: string, line: int, snippet: string, confidence: string, entropy: double>>>>>"
    rows = lines.where(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("j"))
    rules = rows.select(F.explode("j.findings_by_rule").alias("r")).select("r.id", F.explode("r.matches.finding").alias("f"))
    return rules.select(F.lit("kingfisher").alias("scanner"), F.col("f.path").alias("file"), F.col("f.snippet").alias("match"), F.col("f.line").cast("string").alias("position"), F.col("id").alias("rule"))


def detect_secrets(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    return detect_secrets_rows(spark.read.text(path, wholetext=True), lines)


def detect_secrets_rows(captures: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """A map of file to findings; with lines(file, line_no, text) the line's text is the match."""
    raw = captures.select(F.from_json("value", "results map<string, array<struct<type: string, line_number: int, is_verified: boolean>>>").alias("j")).select("j.results")
    flat = raw.select(F.explode("results").alias("file", "fs")).select("file", F.explode("fs").alias("f"))
    flat = flat.select(F.lit("detect_secrets").alias("scanner"), "file", F.col("f.line_number").alias("line_no"), F.col("f.type").alias("rule"), F.col("f.is_verified").alias("verified"))
    text = flat.join(lines, ["file", "line_no"], "left") if lines is not None else flat.withColumn("text", F.lit(None).cast("string"))
    return text.select("scanner", "file", F.col("text").alias("match"), F.col("line_no").cast("string").alias("position"), "rule", "verified")


def deepsecrets(spark: SparkSession, path: str) -> DataFrame:
    return deepsecrets_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("capture"), "value"))


def deepsecrets_rows(captures: DataFrame) -> DataFrame:
    """captures(capture, value): maps of file to lines; of a capture's lines with one 100-character head the first counts, cut to it."""
    raw = captures.select("capture", F.from_json("value", "map<string, array<struct<line: string>>>").alias("m"))
    flat = raw.select("capture", F.posexplode(F.map_entries("m")).alias("nth", "e")).select("capture", "nth", F.col("e.key").alias("file"), F.posexplode("e.value.line").alias("at", "line")).withColumn("match", F.left("line", F.lit(100)))
    once = first_seen(flat, ["capture", "match"], ["nth", "at"])
    return once.select(F.lit("deepsecrets").alias("scanner"), "file", "match", F.col("at").cast("string").alias("position"), F.lit(None).cast("string").alias("rule"))


#: What a line of the scanner's own says.
SERVICE_LINES = ["[ERROR] Matched one or more prohibited patterns", "Syntax error:", "newline unexpected", "Usage:", "git-secrets"]


def git_secrets(spark: SparkSession, path: str) -> DataFrame:
    return git_secrets_rows(spark.read.text(path))


def git_secrets_rows(lines: DataFrame) -> DataFrame:
    """lines(value) of file:line:match or file:match with a match of three characters or more; bare lines of six or more are matches
    themselves; the scanner's own lines are none."""
    line = F.trim("value")
    p = F.split(line, ":", 3)
    own = F.lit(False)
    for s in SERVICE_LINES:
        own = own | F.contains(line, F.lit(s))
    df = lines.where(~own).select(F.when(F.size(p) > 1, F.trim(p[0])).alias("file"), F.trim(F.element_at(p, -1)).alias("match"), F.when(F.size(p) == 3, F.trim(F.get(p, 1))).alias("position"))
    long = (F.col("file").isNotNull() & (F.length("match") >= 3)) | (F.col("file").isNull() & (F.length("match") >= 6))
    return df.where(long).select(F.lit("gitsecrets").alias("scanner"), "file", "match", "position", F.lit(None).cast("string").alias("rule"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_rows(spark.read.text(path))


def url_rows(lines: DataFrame) -> DataFrame:
    """Trimmed valid addresses of lines(value); blank and // lines are none."""
    return lines.select(F.trim("value").alias("url")).where(~F.col("url").startswith("//") & valid_listed_url(F.col("url")))


def dorks(df: DataFrame) -> DataFrame:
    """dorks(company_id, dork) with base64 of a comma-separated list, one row per term."""
    return df.select("company_id", F.explode(F.split(F.decode(F.unbase64("dork"), "UTF-8"), ", ")).alias("term"))


def repo_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below path: file, line_no, text."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
