"""What a benchmark run says: capped plans, totals, results by company, scanner and type, and reports of these as text, Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.operators import ranking

#: Search terms and repositories of a company that a run takes, and secret types that a report lists.
MOST_DORKS, MOST_REPOS, TOP_TYPES = 50, 100, 10


def planned(rows: DataFrame, order: list[str], most: int, company: str = "company") -> DataFrame:
    """The first ``most`` search terms or repositories of each company."""
    return ranking.capped(rows, [company], order, most)


def pooled(*tokens: Column) -> Column:
    """One pool of several arrays of tokens, in their order; a token named twice takes its turn twice."""
    return F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in tokens))


def _per(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def by_company(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """company, dorks, repos, scanned, too_large, failed, seconds, findings, real, false_positives, review, from scans(company, dork, repo, state, seconds),
    state 'ok', 'too_large' or 'failed', and findings(company, outcome), outcome 'real', 'false' or 'review'. A company without findings has 0."""
    state = lambda s: F.count_if(F.col("state") == s)
    s = scans.groupBy("company").agg(F.countDistinct("dork").alias("dorks"), F.count("*").alias("repos"), state("ok").alias("scanned"), state("too_large").alias("too_large"), state("failed").alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("double").alias("seconds"))
    came = lambda o: F.count_if(F.col("outcome") == o)
    f = findings.groupBy("company").agg(F.count("*").alias("findings"), came("real").alias("real"), came("false").alias("false_positives"), came("review").alias("review"))
    return s.join(f, "company", "left").na.fill(0, ["findings", "real", "false_positives", "review"])


def totals(companies: DataFrame) -> DataFrame:
    """One row: sums of by_company, success_rate, precision (in percent), repos_per_hour and secrets_per_hour (null where no time passed)."""
    names = [c for c in companies.columns if c != "company"]
    t = companies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    hours = F.nullif(F.col("seconds"), F.lit(0.0)) / 3600
    return t.select("*", (_per(F.col("scanned"), F.col("repos")) * 100).alias("success_rate"), (_per(F.col("real"), F.col("findings")) * 100).alias("precision"), (F.col("scanned") / hours).alias("repos_per_hour"), (F.col("real") / hours).alias("secrets_per_hour"))


def _number(x: str) -> Column:
    return F.when(F.col(x).isNull(), "-").otherwise(F.format_string("%.1f", F.col(x).cast("double")))


def report(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """section, place, key, value: all lines of a report, of findings(company, scanner, type, outcome) too. It has a line for each company and scanner."""
    companies = by_company(scans, findings)
    t = totals(companies)
    whole = ["dorks", "repos", "scanned", "too_large", "failed", "findings", "real", "false_positives", "review"]
    rates = ["success_rate", "precision", "repos_per_hour", "secrets_per_hour"]
    cells = [F.struct(F.lit(i).cast("long").alias("place"), F.lit(k).alias("key"), (F.col(k).cast("long").cast("string") if k in whole else _number(k)).alias("value")) for i, k in enumerate(whole + rates)]
    out = t.select(F.lit("totals").alias("section"), F.explode(F.array(*cells)).alias("r")).select("section", "r.*")

    def counted(section: str, key: str) -> DataFrame:
        g = findings.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        g = g.orderBy(F.desc("n"), key).limit(TOP_TYPES) if section == "types" else g
        return g.select(F.lit(section).alias("section"), (-F.col("n")).alias("place"), F.col(key).cast("string").alias("key"), F.col("n").cast("string").alias("value"))

    minute = F.when(F.col("seconds") > 0, F.format_string("%.1f", F.col("scanned") * 60 / F.col("seconds"))).otherwise("-")
    said = F.concat_ws(" | ", F.col("dorks").cast("string"), F.col("repos").cast("string"), F.col("scanned").cast("string"), F.col("real").cast("string"), F.col("false_positives").cast("string"), minute)
    each = companies.select(F.lit("companies").alias("section"), F.lit(0).cast("long").alias("place"), F.col("company").cast("string").alias("key"), said.alias("value"))
    return out.unionByName(counted("scanners", "scanner")).unionByName(counted("types", "type")).unionByName(each)


#: Heads of a report's sections, in their order.
HEADS = {
    "totals": "| measure | value |\n| --- | --- |",
    "scanners": "| scanner | findings |\n| --- | --- |",
    "types": "| type | findings |\n| --- | --- |",
    "companies": "| company | terms | repositories | scanned | real | false | repositories a minute |\n| --- | --- | --- | --- | --- | --- | --- |",
}


def rendered(lines: DataFrame, form: str) -> DataFrame:
    """section, value: a section's text each, as 'md' or 'txt', in the order of HEADS; ``lines`` as report gives them, sections hold few."""
    line = lambda r: F.concat(F.lit("| "), r["key"], F.lit(" | "), r["value"], F.lit(" |")) if form == "md" else F.concat(F.lit("  "), r["key"], F.lit(": "), r["value"])
    rows = F.array_sort(F.collect_list(F.struct("place", "key", "value")))
    sections = F.create_map(*(F.lit(x) for k, v in HEADS.items() for x in (k, f"## {k}\n\n{v}" if form == "md" else k.upper())))
    text = F.concat_ws("\n", sections[F.col("section")], F.array_join(F.transform(rows, line), "\n"))
    return lines.groupBy("section").agg(text.alias("value"))


def write(lines: DataFrame, path: str) -> None:
    """path/json, path/md and path/txt: the lines as JSON, the sections as text, each in one file."""
    order = F.array_position(F.array(*map(F.lit, HEADS)), F.col("section"))
    lines.orderBy(order, "place", "key").coalesce(1).write.mode("overwrite").json(f"{path}/json")
    for form in ("md", "txt"):
        rendered(lines, form).orderBy(order).select("value").coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(f"{path}/{form}")
