"""Quotas of tokens as a stream with timers: a token comes back by itself when its reset or the end of its block passes.

The state of a (token, resource) is its last known values, each with the time that it was said at, so rows may come in any order; timers
are in event time, so a rerun gives the same rows. ``quotas_at`` is the same rule over a table, at one moment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an answer may say; each may be null.
SAID = ("limit", "remaining", "reset", "blocked_until")
#: Seconds without an answer after which a quota's state is dropped.
IDLE = 7 * 86_400
OUT = "token string, resource string, at long, kind string, limit long, remaining long, reset long, blocked boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quotas_at(answers: DataFrame, now: Column) -> DataFrame:
    """token, resource, limit, remaining, reset, blocked at ``now`` (seconds), from answers(token, resource, at, limit, remaining, reset,
    blocked_until), at in seconds: each value as it was said last up to now (of one moment the largest). Once its reset has passed, a quota
    has its limit again, unless what remains was said later; a block ends at blocked_until. Tokens not heard of for IDLE seconds are left out."""
    said = answers.where(F.col("at") <= now)
    last = [F.max(F.when(F.col(k).isNotNull(), F.struct("at", F.col(k).alias("v")))).alias(k) for k in SAID]
    g = said.groupBy("token", "resource").agg(*last, F.max("at").alias("seen")).where(F.col("seen") + IDLE > now)
    again = (F.col("reset.v") <= now) & (F.coalesce(F.col("remaining")["at"], F.lit(-1)) < F.col("reset.v"))
    left = F.when(F.coalesce(again, F.lit(False)), F.coalesce("limit.v", "remaining.v")).otherwise(F.col("remaining.v"))
    return g.select("token", "resource", F.col("limit.v").alias("limit"), left.alias("remaining"), F.col("reset.v").alias("reset"), F.coalesce(F.col("blocked_until.v") > now, F.lit(False)).alias("blocked"))


class _Quota(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("quota", ", ".join(f"{k} long, {k}_at long" for k in SAID) + ", seen long, told long")

    def _row(self, key: tuple, now: dict, at: int, kind: str) -> pd.DataFrame:
        left = now["limit"] if self._reset_passed(now, at) and now["limit"] is not None else now["remaining"]
        blocked = now["blocked_until"] is not None and now["blocked_until"] > at
        row = pd.DataFrame({"token": [key[0]], "resource": [key[1]], "at": [at], "kind": [kind], "limit": [now["limit"]], "remaining": [left], "reset": [now["reset"]], "blocked": [blocked]})
        return row.astype({"at": "Int64", "limit": "Int64", "remaining": "Int64", "reset": "Int64"})

    def _reset_passed(self, now: dict, at: int) -> bool:
        return now["reset"] is not None and now["reset"] <= at and (now["remaining_at"] is None or now["remaining_at"] < now["reset"])

    def _load(self) -> dict:
        names = [x for k in SAID for x in (k, f"{k}_at")] + ["seen", "told"]
        return dict(zip(names, self.state.get() if self.state.exists() else [None] * len(names), strict=True))

    def _times(self, now: dict, after: int) -> None:
        """Timers for the next reset, the end of a block and the end of the state; those of values that no longer hold go."""
        want = {t * 1000 for t in (now["reset"], now["blocked_until"]) if t is not None and t > after} | {(now["seen"] + IDLE) * 1000}
        have = set(self.handle.listTimers())
        for t in have - want:
            self.handle.deleteTimer(t)
        for t in want - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._load()
        for pdf in rows:
            for r in pdf[["at", *SAID]].itertuples(index=False):
                for k, v in zip(SAID, r[1:], strict=True):
                    if not pd.isna(v) and (now[f"{k}_at"] is None or (int(r[0]), int(v)) >= (now[f"{k}_at"], now[k])):
                        now[k], now[f"{k}_at"] = int(v), int(r[0])
                now["seen"] = max(now["seen"] or 0, int(r[0]))
        at = max(now["seen"], now["told"] or 0)
        now["told"] = at
        self.state.update(tuple(now.values()))
        # a reset between the watermark and the latest answer is told of now, but its timer stays: later rows may still change what it finds
        self._times(now, timerValues.getCurrentWatermarkInMs() // 1000)
        yield self._row(key, now, at, "answer")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = self._load(), expiredTimerInfo.getExpiryTimeInMs() // 1000
        if now["seen"] is None:
            return
        if at >= now["seen"] + IDLE:
            self.state.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            yield self._row(key, now, at, "dropped")
            return
        now["told"] = max(at, now["told"] or 0)
        self.state.update(tuple(now.values()))
        if at == now["reset"] or at == now["blocked_until"]:
            yield self._row(key, now, now["told"], "reset" if at == now["reset"] else "unblocked")

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need; streams that run already keep theirs."""
    spark.conf.set(_PROVIDER, _ROCKS)


def quota_changes(answers: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A row whenever what is known of a (token, resource) changes: token, resource, at, kind ('answer', 'reset', 'unblocked', 'dropped'), limit,
    remaining, reset, blocked, for a stream of answers as in ``quotas_at``. A row's values hold at its ``at``, which never falls. Answers
    of one trigger give one row. Rows later than ``lateness`` behind the latest are dropped; rows without at, token or resource don't count."""
    use_rocksdb(answers.sparkSession)
    timed = answers.where("at is not null and token is not null and resource is not null").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", lateness)
    return timed.groupBy("token", "resource").transformWithStateInPandas(_Quota(), OUT, "append", "EventTime")


def latest_changes(changes: DataFrame, now: Column) -> DataFrame:
    """What quota_changes' rows say of each quota up to ``now``: as quotas_at, once the stream's watermark has passed now."""
    rank = F.struct("at", F.when(F.col("kind") == "answer", 0).otherwise(1), "reset")
    last = changes.where(F.col("at") <= now).groupBy("token", "resource").agg(F.max_by(F.struct("kind", "limit", "remaining", "reset", "blocked"), rank).alias("c"))
    return last.where("c.kind <> 'dropped'").select("token", "resource", "c.limit", "c.remaining", "c.reset", "c.blocked")
