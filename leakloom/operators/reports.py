"""Report aggregates over leak rows (id, url, level, found_at, leak_type, result, company_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import text as T

#: Risk weight of a level.
RISK = {0: 1, 1: 3, 2: 6, 3: 10}


def r1(c: Column) -> Column:
    return F.round(c.cast("double"), 1)


def in_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """Both bounds are midnights, as BETWEEN dates says; newest first."""
    return df.where(F.col("found_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy(F.desc("found_at"))


def counts_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt"))


def basic_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.coalesce(F.avg("level"), F.lit(0.0)).alias("avg_level"), F.count_if(F.col("level") >= 2).alias("serious"), F.count_if(F.col("level") >= 3).alias("critical"), F.countDistinct(F.when(F.col("company_id") != 0, F.col("company_id"))).alias("companies"), F.countDistinct("url").alias("urls"))


def top_types(df: DataFrame, n: int = 10) -> DataFrame:
    return counts_by(df, "leak_type").orderBy(F.desc("cnt"), "leak_type").limit(n)


def category_breakdown(df: DataFrame) -> DataFrame:
    g = df.groupBy(T.business_category(F.col("leak_type")).alias("category")).agg(F.count("*").alias("incidents"), F.avg("level").alias("a"))
    share = F.col("incidents").cast("double") * 100.0 / F.sum("incidents").over(W.partitionBy())
    return g.select("category", "incidents", r1(F.col("a")).alias("avg_level"), r1(share).alias("percentage"))


def company_breakdown(df: DataFrame, n: int = 10) -> DataFrame:
    g = df.where("company_id <> 0").groupBy("company_id").agg(F.count("*").alias("total"), F.count_if(F.col("result") == 1).alias("resolved"), F.count_if(F.col("result") == 0).alias("pending"))
    return g.orderBy(F.desc("total"), "company_id").limit(n)


def platform_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy(P.platform(F.col("url")).alias("platform")).agg(F.countDistinct("url").alias("repos"), F.count("*").alias("leaks"))


def risk_score(df: DataFrame) -> DataFrame:
    w = F.coalesce(F.create_map(*(F.lit(x) for kv in RISK.items() for x in kv))[F.col("level")], F.lit(0))
    return df.agg(F.coalesce(r1(F.avg(w)), F.lit(0.0)).alias("risk"))


def peak_hour(df: DataFrame) -> DataFrame:
    """The hour with most leaks, the smallest if several: rows of a table have no first one."""
    g = df.groupBy(F.hour("found_at").alias("h")).agg(F.count("*").alias("c"))
    return g.agg(F.coalesce(F.max_by("h", F.struct("c", -F.col("h"))), F.lit(0)).alias("peak_hour"))


def monthly_trends(df: DataFrame, months: int = 12) -> DataFrame:
    """The last months that have incidents, in their order."""
    g = df.groupBy(F.date_format("found_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("incidents"), F.count_if(F.col("result") == 1).alias("resolved"))
    return g.orderBy(F.desc("month")).limit(months).withColumn("efficiency", F.round(F.col("resolved") * 100.0 / F.col("incidents")).cast("int")).orderBy("month")


def technical_types(df: DataFrame) -> DataFrame:
    g = df.groupBy(T.business_category(F.col("leak_type"), technical=True).alias("category")).agg(F.count("*").alias("cnt"), F.avg((F.col("level") + 1) * 25.0).alias("s"))
    return g.select("category", "cnt", r1(F.col("s")).alias("severity"))


def risky_repos(df: DataFrame, n: int = 5) -> DataFrame:
    g = df.groupBy("url").agg(F.count("*").alias("issues"), F.max("level").alias("max_level")).orderBy(F.desc("issues"), F.desc("max_level"), "url").limit(n)
    label = F.when(F.col("max_level") >= 3, "critical").when(F.col("max_level") >= 2, "high").otherwise("medium")
    return g.select("url", F.element_at(F.split("url", "/"), -1).alias("name"), "issues", "max_level", label.alias("severity"))


def scanner_metrics(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.countDistinct("url").alias("unique_urls"), F.greatest(F.lit(1), F.floor(n / 20)).cast("long").alias("false_positives"))


def template_metrics(df: DataFrame) -> DataFrame:
    """What the report pages derive: accuracy, violations, risk groups, leaks per repository."""
    n, ok, crit, urls = F.count("*"), F.count_if(F.col("result") == 1), F.count_if(F.col("level") >= 3), F.countDistinct("url")
    part = lambda c, k: F.greatest(F.lit(1), F.floor(c / k)).cast("long")
    return df.agg(r1(ok * 100.0 / n).alias("accuracy"), part(crit, 5).alias("violations"), part(n, 6).alias("high"), part(n, 4).alias("medium"), part(n, 3).alias("low"), r1(n / F.greatest(urls, F.lit(1))).alias("leaks_per_repo"))


def committer_analysis(df: DataFrame) -> DataFrame:
    """Per repo: any corporate committer, whether all are public (false when none), and how many distinct."""
    corporate = P.is_corporate(F.col("email"))
    return df.groupBy("repo").agg(F.bool_or(corporate).alias("corporate"), F.every(~corporate).alias("all_public"), F.countDistinct("name", "email").alias("people"))


def scan_metrics(df: DataFrame) -> DataFrame:
    """From (quality, toxic) labels as (real, flagged): precision and rates with denominators of at least 1."""
    real, hit = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)), F.count_if(F.col("toxic") == 1)
    return df.agg(hit.alias("found"), real.alias("real"), F.round(real / F.greatest(F.lit(1), hit), 6).alias("precision"), F.round(hit / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"))


def first_peak_hour(df: DataFrame, order: str = "id") -> DataFrame:
    """The hour with most leaks, of several that which a leak came in first; 0 for none."""
    g = df.groupBy(F.hour("found_at").alias("h")).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    return g.agg(F.coalesce(F.max_by("h", F.struct("c", -F.col("first"))), F.lit(0)).alias("peak_hour"))


def status_breakdown(df: DataFrame) -> DataFrame:
    """result, cnt, percentage of all, and how many counted as done."""
    g = counts_by(df, F.col("result").cast("string").alias("result"))
    return g.withColumn("percentage", r1(F.col("cnt") * 100.0 / F.sum("cnt").over(W.partitionBy()))).withColumn("done", F.coalesce(F.col("result") == "1", F.lit(False)))


def created_daily(df: DataFrame, time: str = "created_at") -> DataFrame:
    return counts_by(df.where(F.col(time).isNotNull()), F.to_date(time).alias("day")).orderBy("day")


def error_analysis(reports: DataFrame) -> DataFrame:
    """One row: error_reports, successful_reports, too_large_repo_errors of reports(raw text, ai VARIANT)."""
    c = F.col
    said = F.coalesce(F.try_variant_get("ai", "$.Thinks", "string") == "Not state", F.lit(False))
    filters = F.lower(F.coalesce(F.to_json(F.try_variant_get("ai", "$.filters", "variant")), F.lit("")))
    large = filters.rlike("too large|слишком большой|repository is too big")
    bad = said | large | F.coalesce(F.lower(c("raw")).contains("error"), F.lit(False))
    return reports.agg(F.count_if(bad).alias("error_reports"), F.count_if(~bad).alias("successful_reports"), F.count_if(large).alias("too_large_repo_errors"))


def nested_keys(findings: DataFrame) -> DataFrame:
    """By repo: keys of its report as a nested document, scanners, findings and their fields (fields: an array)."""
    return findings.groupBy("repo").agg((F.countDistinct("scanner") + F.count("*") + F.sum(F.size("fields"))).alias("keys"))


#: Risk, usual places and marks of each technical category in a report, and its numbers that are no measurements.
TECHNICAL = {
    "API Keys": ("high", ["config/", "src/", ".env"], ["GOOGLE_API_KEY", "FIREBASE_KEY", "GCP_KEY"]),
    "Database Credentials": ("critical", ["config/", "scripts/", "docker/"], ["DATABASE_URL", "DB_PASSWORD", "MYSQL_ROOT"]),
    "Private Keys": ("critical", ["ssl/", "certs/", ".ssh/"], ["-----BEGIN RSA", "-----BEGIN PRIVATE", "id_rsa"]),
    "Debug Information": ("medium", ["logs/", "debug/", "tmp/"], ["console.log", "print(", "DEBUG=true"]),
    "Other": ("medium", ["various/"], ["various patterns"]),
}
DETECTION_RATE, SCAN_SECONDS, RESOLUTION_DAYS, PREVIOUS_RISK = 89.4, 45, 2.8, 0.7


def labelled_types(df: DataFrame) -> DataFrame:
    """technical_types with the risk_level, locations and patterns that the report gives the category, most frequent first."""
    known = F.create_map(*(x for k, (risk, places, marks) in TECHNICAL.items() for x in (F.lit(k), F.struct(F.lit(risk).alias("risk_level"), F.array(*map(F.lit, places)).alias("locations"), F.array(*map(F.lit, marks)).alias("patterns")))))
    return technical_types(df).withColumn("__k", known[F.col("category")]).select("category", "cnt", "severity", "__k.*").orderBy(F.desc("cnt"), "category")


def constant_metrics(df: DataFrame) -> DataFrame:
    """scanner_metrics with the numbers that a report of this form carries as constants."""
    return scanner_metrics(df).withColumns({"detection_rate": F.lit(DETECTION_RATE), "average_scan_seconds": F.lit(SCAN_SECONDS), "resolution_days": F.lit(RESOLUTION_DAYS)})


def severity_label(level: Column) -> Column:
    return F.when(level >= 2.5, "high").when(level >= 1.5, "medium").otherwise("low")


def risk_bars(df: DataFrame) -> DataFrame:
    """level (high, medium, low), repos, share of all three, previous and trend of the report's risk bars."""
    m = template_metrics(df).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("high", "medium", "low"))), F.array("high", "medium", "low"))).alias("level", "repos"))
    share = F.round(F.col("repos") * 100.0 / F.sum("repos").over(W.partitionBy()), 1)
    return m.select("level", "repos", share.alias("share"), (F.col("repos") + PREVIOUS_RISK).alias("previous"), F.lit("decreasing").alias("trend"))


def month_bars(df: DataFrame) -> DataFrame:
    """Monthly trends with the heights of a month's bars: 200 for the most incidents, 150 for the most resolved."""
    high = lambda c, n: F.round(F.col(c) * float(n) / F.greatest(F.max(c).over(W.partitionBy()), F.lit(1)), 1)
    return monthly_trends(df).withColumns({"incidents_height": high("incidents", 200), "resolved_height": high("resolved", 150)})


def company_efficiency(df: DataFrame, n: int = 10) -> DataFrame:
    """company_breakdown with the share resolved and its colour."""
    g = company_breakdown(df, n).withColumn("efficiency", F.round(F.col("resolved") * 100.0 / F.greatest(F.col("total"), F.lit(1))).cast("int"))
    return g.withColumn("colour", F.when(F.col("efficiency") >= 80, "green").when(F.col("efficiency") >= 60, "yellow").otherwise("red"))


def type_shares(df: DataFrame, n: int = 10) -> DataFrame:
    """top_types with their share of all incidents; a missing type is Unknown."""
    all_ = df.withColumn("leak_type", F.coalesce("leak_type", F.lit("Unknown")))
    return counts_by(all_, "leak_type").withColumn("percentage", r1(F.col("cnt") * 100.0 / F.sum("cnt").over(W.partitionBy()))).orderBy(F.desc("cnt"), "leak_type").limit(n)


def throughput(df: DataFrame) -> DataFrame:
    """One row from scans(seconds, findings, real, ok): precision, success_rate, repos_per_hour, secrets_per_hour; denominators are 1 at least."""
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    n, hours = F.count("*"), F.sum("seconds") / 3600
    over = lambda a: F.when(F.sum("seconds") > 0, a / hours).otherwise(0.0)
    return df.agg(per(F.sum("real"), F.sum("findings")).alias("precision"), per(F.count_if("ok"), n).alias("success_rate"), over(n).alias("repos_per_hour"), over(F.sum("findings")).alias("secrets_per_hour"))


def page(title: str, frames: dict[str, DataFrame], rows: int = 100) -> str:
    """An HTML page with a table for each of some aggregates (a report's tables have few rows; ``rows`` are shown); all text is escaped."""
    from html import escape

    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in frames.items():
        body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table>")
    return "\n".join(out)


def shortened(t: Column, n: int) -> Column:
    """Up to n characters, the last three as dots where some are missing."""
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def by_status(df: DataFrame) -> DataFrame:
    return counts_by(df, F.col("result").cast("string").alias("result"))


def average_level(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg("level"), F.lit(0.0)).alias("avg_level"))


def distinct_companies(df: DataFrame) -> DataFrame:
    """Companies with a number other than 0."""
    return df.agg(F.countDistinct(F.when(F.col("company_id") != 0, F.col("company_id"))).alias("n"))


def distinct_urls(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("url").alias("n"))


def daily(df: DataFrame, time: str = "found_at") -> DataFrame:
    return counts_by(df, F.to_date(time).alias("day"))


def serious(df: DataFrame, least: int = 2) -> DataFrame:
    return df.where(F.col("level") >= least)


def top_leaks(df: DataFrame, n: int = 10) -> DataFrame:
    """The gravest incidents, of equal ones the newest."""
    return df.orderBy(F.desc("level"), F.desc("found_at"), "id").limit(n)


def level_shares(df: DataFrame) -> DataFrame:
    g = counts_by(df, "level")
    return g.select("level", F.round(F.col("cnt") / F.sum("cnt").over(W.partitionBy()), 6).alias("share"))


def first_matches(findings: DataFrame, order: list[str]) -> DataFrame:
    """repo, match: a repository's first finding."""
    return findings.groupBy("repo").agg(F.min_by("match", F.struct(*order)).alias("match"))
