"""Daily sketches of incidents: distinct counts and quantiles of any period, without reading incidents again.

A day's sketch is a few kilobytes, whatever the day held; sketches of days merge into that of a period. Distinct counts are HyperLogLog
of 2^LG_K registers, with a relative standard error of 1.04 / sqrt(2^LG_K); quantiles are KLL of K items, whose rank is off by
less than 1.33 % (K = 200) with 99 % certainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200
#: Three standard errors of a distinct count, and the error of a rank.
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0133


def daily(incidents: DataFrame) -> DataFrame:
    """day, n, companies, urls, levels: one row a day of incidents(found_at, company_id, url, level); null and 0 companies don't count."""
    company = F.when(F.col("company_id") != 0, F.col("company_id").cast("long"))
    return incidents.groupBy(F.to_date("found_at").alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(company, LG_K).alias("companies"), F.hll_sketch_agg("url", LG_K).alias("urls"), F.kll_sketch_agg_double(F.col("level").cast("double"), K).alias("levels")
    )


def appended(stored: DataFrame, incidents: DataFrame) -> DataFrame:
    """Stored days with those of new incidents: a day that both know has its sketches merged. Incidents that are stored already
    change no distinct count, but they'd count twice in n and levels, so a batch must be new."""
    both = stored.unionByName(daily(incidents))
    return both.groupBy("day").agg(F.sum("n").alias("n"), F.hll_union_agg("companies").alias("companies"), F.hll_union_agg("urls").alias("urls"), F.kll_merge_agg_double("levels").alias("levels"))


def period(stored: DataFrame, first: Column | None = None, last: Column | None = None, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row: n, companies, urls (estimates) and levels (the values at ``ranks``) of the days from first to last, both included; None: open.
    Without such days the counts are 0 and the values null."""
    days = stored
    for bound, inside in ((first, lambda d: d >= first), (last, lambda d: d <= last)):
        days = days if bound is None else days.where(inside(F.col("day")))
    merged = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_union_agg("companies").alias("c"), F.hll_union_agg("urls").alias("u"), F.kll_merge_agg_double("levels").alias("l"))
    count = lambda s: F.coalesce(F.hll_sketch_estimate(s), F.lit(0))
    values = F.when(F.col("n") > 0, F.array(*(F.kll_sketch_get_quantile_double("l", F.lit(r)) for r in ranks)))
    return merged.select("n", count("c").alias("companies"), count("u").alias("urls"), values.alias("levels"))
