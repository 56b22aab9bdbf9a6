"""Store operators over DataFrames: scans, anti-joins, first-seen dedup, caps, numbering, upsert, lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scan(df: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Equality filters, then a page in key order."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (filters or {}).items(), df).orderBy(key)
    return out.offset(offset).limit(limit) if limit is not None else out


def unseen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key isn't known; Spark picks the join by the sizes it sees."""
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def first_seen(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, by a mergeable aggregate; rows of equal order are told apart by their other columns."""
    names = df.columns
    by = [F.col(k).alias(f"__k{i}") if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(keys)]
    least = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*by).agg(F.min_by(F.struct(*names), least).alias("__r")).select("__r.*")


def capped(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each key: the cap is what the operator means."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "leak_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by a mergeable aggregate."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """new over old: a row whose ``changed`` columns all equal the stored ones keeps the stored row."""
    n = new.select(F.struct(*new.columns).alias("n"), F.col(key).alias("__k"))
    o = old.select(F.struct(*old.columns).alias("o"), F.col(key).alias("__k"))
    both = o.join(n, "__k", "full_outer")
    same = reduce(lambda a, c: a & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), changed, F.lit(True))
    pick = F.when(F.col("n").isNull() | (F.col("o").isNotNull() & same), F.col("o")).otherwise(F.col("n"))
    return both.select(pick.alias("r")).select("r.*")


def reconciled(leaks: DataFrame, reachable: DataFrame, key: str = "url") -> DataFrame:
    """Leaks that can't be reached any more: blocked ones close (1 to 3), those for a deep scan wait (5 to 2)."""
    gone = leaks.join(reachable.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    new = F.when(F.col("__there").isNull() & (F.col("result") == 1), 3).when(F.col("__there").isNull() & (F.col("result") == 5), 2).otherwise(F.col("result"))
    return gone.withColumn("result", new).drop("__there").select(*leaks.columns)


def stats_coerced(df: DataFrame, ints: list[str], bools: list[str]) -> DataFrame:
    out = {c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)) for c in ints}
    out |= {c: F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "1", "yes"), F.lit(False)) for c in bools}
    return df.withColumns(out)
