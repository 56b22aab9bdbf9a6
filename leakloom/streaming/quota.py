"""Quotas of interfaces' tokens, providers and caches, from tables or streams of what was answered and used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests of each resource that stay in reserve.
RESERVE = {"core": 100, "search": 2, "search_code": 1, "graphql": 100}


def reserve(resource: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RESERVE.items() for x in kv))[resource], F.lit(1))


def quotas(answers: DataFrame) -> DataFrame:
    """token, resource, limit, remaining, reset, last_check: the last known value of each, from answers(token, resource, at, limit, remaining, reset)."""
    last = lambda k: F.max_by(k, F.when(F.col(k).isNotNull(), F.col("at"))).alias(k)
    some = answers.where("limit is not null or remaining is not null or reset is not null")
    return some.groupBy("token", "resource").agg(last("limit"), last("remaining"), last("reset"), F.max("at").alias("last_check"))


def quota_stream(answers: DataFrame) -> DataFrame:
    """quotas of a stream, a row whenever a token's quota of a resource changes; its state is three numbers a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, None]
        for pdf in frames:
            for row in pdf.sort_values("at")[["limit", "remaining", "reset"]].itertuples(index=False):
                now = [old if pd.isna(new) else int(new) for old, new in zip(now, row, strict=True)]
        state.update(tuple(now))
        yield pd.DataFrame({"token": [key[0]], "resource": [key[1]], "limit": [now[0]], "remaining": [now[1]], "reset": [now[2]]}).astype({k: "Int64" for k in ("limit", "remaining", "reset")})

    return answers.groupBy("token", "resource").applyInPandasWithState(step, "token string, resource string, limit long, remaining long, reset long", "limit long, remaining long, reset long", "update", GroupStateTimeout.NoTimeout)


def available(quota: DataFrame, now: Column) -> DataFrame:
    """Quotas that may be drawn on: not blocked now (blocked_until, null: no), and above the reserve or past their reset."""
    free = F.col("blocked_until").isNull() | (F.col("blocked_until") <= now)
    return quota.where(free & ((F.col("remaining") >= reserve(F.col("resource"))) | (now >= F.col("reset"))))


def best_token(quota: DataFrame, now: Column) -> DataFrame:
    """resource, token: of the available ones that with most remaining, else that which resets first; ties to the first name."""
    most = available(quota, now).groupBy("resource").agg(F.min_by("token", F.struct((-F.col("remaining")).alias("less"), "token")).alias("best"))
    early = quota.groupBy("resource").agg(F.min_by("token", F.struct(F.when(F.col("reset") > 0, F.col("reset")).otherwise(F.lit(2**62)), "token")).alias("early"))
    return early.join(most, "resource", "left").select("resource", F.coalesce("best", "early").alias("token"))


def ready_providers(providers: DataFrame, now: Column) -> DataFrame:
    """Providers that may be asked: under three errors, fifty below their daily limit (null: none), and not sooner than their rate
    allows; the one that waited longest first."""
    d = F.col("daily_limit")
    ok = (F.coalesce("error_count", F.lit(0)) < 3) & (d.isNull() | (F.coalesce("requests_count", F.lit(0)) < d - 50)) & (now - F.coalesce("last_request", F.lit(0)) >= 60 / F.greatest(F.coalesce("rpm", F.lit(1)), F.lit(1)))
    return providers.where(ok).orderBy(F.coalesce("last_request", F.lit(0)), "name")


def queued(tasks: DataFrame, capacity: int) -> DataFrame:
    """tasks(id, priority, submitted_at) with state: 'queued' in the order they are served (high, normal, low), or 'dropped' where the
    queue was full when they came."""
    rank = F.create_map(*(F.lit(x) for i, v in enumerate(("high", "normal", "low")) for x in (v, i)))[F.col("priority")]
    first = tasks.orderBy("submitted_at", "id").limit(capacity)  # no more rows than the queue holds are ranked
    held = first.select("id", "submitted_at", F.row_number().over(W.orderBy(rank, "submitted_at", "id")).alias("place"))
    out = tasks.join(held, ["id", "submitted_at"], "left")
    return out.select(*tasks.columns, F.when(F.col("place").isNull(), "dropped").otherwise("queued").alias("state"), "place")


def evicted(cache: DataFrame, keep: int) -> DataFrame:
    """Entries of a cache that a clean-up removes: all but the ``keep`` that were used last; ties to the last name."""
    newest = cache.orderBy(F.desc("last_access"), F.desc("url")).limit(keep)
    return cache.join(newest.select("url"), "url", "left_anti")


def cache_stats(cache: DataFrame, uses: DataFrame, max_bytes: int) -> DataFrame:
    """One row: repo_count, total_size_bytes, usage_percent, cache_hits, cache_misses, cache_hit_rate; shares of nothing are 0."""
    size = cache.agg(F.lit(1).alias("one"), F.count("*").alias("repo_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))
    hits = uses.agg(F.lit(1).alias("one"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    both = size.join(hits, "one").drop("one")  # one row each
    rate = F.col("cache_hits") * 100 / F.greatest(F.col("cache_hits") + F.col("cache_misses"), F.lit(1))
    return both.withColumn("usage_percent", F.col("total_size_bytes") * 100 / max_bytes if max_bytes > 0 else F.lit(0.0)).withColumn("cache_hit_rate", rate)


def status_report(quota: DataFrame, now: Column) -> DataFrame:
    """By token (its first twelve characters): is_blocked, consecutive_errors, resources as a map of remaining, limit and seconds to the reset."""
    cell = F.struct("remaining", "limit", F.greatest(F.col("reset") - now, F.lit(0)).alias("reset_in"))
    g = quota.groupBy("token").agg(F.bool_or(F.coalesce(F.col("blocked_until") > now, F.lit(False))).alias("is_blocked"), F.max("consecutive_errors").alias("consecutive_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("resource", cell.alias("quota"))))).alias("resources"))
    return g.withColumn("token", F.concat(F.left("token", F.lit(12)), F.lit("...")))
