"""Pages of a large table by key, and lookups in it: a stored index of every n-th key says where a page begins, a layout by the key's hash where a key lies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import numbered


def page_index(table: DataFrame, key: str = "id", every: int = 100) -> DataFrame:
    """page, key, n: the first key of each page of ``every`` rows, in order of the key, and the rows of that very key that lie on
    earlier pages. One row a page; nulls first, as in Spark's order."""
    at = numbered(table.select(key).withColumn("__one", F.lit(0)), ["__one"], [key], "__at")
    least = at.groupBy(key).agg(F.min("__at").alias("__first"))
    firsts = at.where(F.col("__at") % every == 0).select((F.col("__at") / every).cast("int").alias("page"), key, "__at")
    both = firsts.alias("f").join(least.alias("l"), F.col(f"f.{key}").eqNullSafe(F.col(f"l.{key}")))
    return both.select("page", F.col(f"f.{key}").alias(key), (F.col("__at") - F.col("__first")).alias("n"))


def page_of(table: DataFrame, index: DataFrame, page: int, key: str = "id", every: int = 100) -> DataFrame:
    """The rows of a page, in order of the key. Two rows of the index give the keys it lies between, which reach the scan as a
    filter, so that files and row groups outside are not read: a page's cost doesn't depend on its number. Rows of one key that lies on two pages are told
    apart by a hash of their columns."""
    ends = {r.page: r for r in index.where(F.col("page").isin(page, page + 1)).collect()}
    if page not in ends:
        return table.limit(0)
    first, after = ends[page], ends.get(page + 1)
    low = F.lit(True) if first[key] is None else F.col(key) >= F.lit(first[key])
    high = F.lit(True) if after is None else F.col(key).isNull() if after[key] is None else (F.col(key) <= F.lit(after[key]) if first[key] is not None else F.col(key).isNull() | (F.col(key) <= F.lit(after[key])))
    near = table.where(low & high)
    # at most the rows of the page and those of its first key on earlier pages
    return near.orderBy(key, F.xxhash64(*table.columns)).offset(first["n"]).limit(every)


def _part(key: str, parts: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int"), F.lit(0))


def write_bucketed(table: DataFrame, path: str, key: str = "url", parts: int = 256) -> None:
    """The table in folders by the hash of its key, a file or more each, rows of a key next to each other."""
    table.withColumn("part", _part(key, parts)).repartition(parts, "part").sortWithinPartitions("part", key).write.mode("append").partitionBy("part").parquet(path)


class Bucketed:
    """A table that write_bucketed has written. A lookup reads the folders that its keys can be in only, and of a few keys the row
    groups; the numbers of folders, no more than there are, go through the driver."""

    def __init__(self, spark: SparkSession, path: str, key: str = "url", parts: int = 256):
        self.spark, self.key, self.parts = spark, key, parts
        self.table = spark.read.parquet(path)

    def lookup(self, keys: Iterable[str | None]) -> DataFrame:
        """Rows of some keys; null ones have none."""
        wanted = [k for k in keys if k is not None]
        return self._near(self.spark.createDataFrame([(k,) for k in wanted], f"{self.key} string")).where(F.col(self.key).isin(wanted)).drop("part")

    def _near(self, keys: DataFrame) -> DataFrame:
        folders = keys.select(_part(self.key, self.parts).alias("part")).distinct().collect()
        return self.table.where(F.col("part").isin([r.part for r in folders]))

    def known(self, candidates: DataFrame) -> DataFrame:
        """The distinct keys of candidates that the table has."""
        new = candidates.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return new.join(self._near(new).select(self.key), self.key, "left_semi")

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose key the table hasn't got; those without a key too."""
        return candidates.join(self.known(candidates), self.key, "left_anti").select(*candidates.columns)
