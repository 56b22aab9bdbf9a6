"""Command line: ``python -m leakloom.cli report|status|metrics|recheck|scan``, over a folder of Parquet tables.

report writes an HTML page of aggregates, status and metrics print rows of JSON, recheck lists incidents to look at again, scan
normalises scanners' captures into findings. Secrets are shown masked only."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import text as T
from leakloom.operators import findings as N
from leakloom.operators import reports as R
from leakloom.operators import store as O
from leakloom.sources import captures as C

READERS = {"gitleaks": C.gitleaks, "trufflehog": C.trufflehog, "kingfisher": C.kingfisher, "deepsecrets": C.deepsecrets, "gitsecrets": C.git_secrets}


def shown(df: DataFrame, most: int) -> None:
    for r in df.limit(most).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def scanned(spark: SparkSession, repo: str, captures: dict[str, str]) -> DataFrame:
    """Findings of one repository's captures (scanner: path), normalised, matches masked."""
    parts = []
    for scanner, path in captures.items():
        rows = READERS[scanner](spark, path).select(F.lit(repo).alias("repo"), "scanner", F.monotonically_increasing_id().alias("seq"), "match", "file", "rule")
        parts.append(rows)
    return N.normalised(N.fan_in(parts)).withColumn("match", T.masked(F.col("match")))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leakloom")
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("report", "status", "metrics", "recheck"):
        s = sub.add_parser(name)
        s.add_argument("leaks", help="Parquet of incidents: id, url, level, found_at, leak_type, result, company_id")
        s.add_argument("--start")
        s.add_argument("--end")
        s.add_argument("--most", type=int, default=100, help="rows shown")
        s.add_argument("--out", default="-")
    s = sub.add_parser("scan")
    s.add_argument("repo")
    s.add_argument("captures", nargs="+", help="scanner=path")
    s.add_argument("--out", required=True, help="folder of JSON lines")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("leakloom").getOrCreate()
    if a.do == "scan":
        O.write_json(scanned(spark, a.repo, dict(c.split("=", 1) for c in a.captures)), a.out)
        return 0
    leaks = spark.read.parquet(a.leaks)
    if a.start and a.end:
        leaks = R.in_period(leaks, a.start, a.end)
    if a.do == "report":
        page = R.page("Incidents", {"Totals": R.basic_stats(leaks), "Status": R.status_breakdown(leaks), "Categories": R.category_breakdown(leaks), "Platforms": R.platform_breakdown(leaks), "Months": R.monthly_trends(leaks), "Repositories": R.risky_repos(leaks), "Types": R.type_shares(leaks)})
        if a.out == "-":
            print(page)
        else:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(page)
    elif a.do == "recheck":
        shown(leaks.where(F.col("result").isin(4, 5) & P.valid_repo_host(F.col("url"))).orderBy(F.desc("result"), "id").select("id", "url", "result"), a.most)
    else:
        shown(R.status_breakdown(leaks) if a.do == "status" else R.constant_metrics(leaks), a.most)
    return 0


if __name__ == "__main__":
    sys.exit(main())
