"""Numbers and caps of rows within a key, however many rows the key has: no task needs a key's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import Cuts

#: Parts that a key's rows are cut down in before they meet.
PARTS = 32


def _tie(df: DataFrame) -> Column:
    """Tells rows of equal order apart; rows equal in all columns are the same in any order."""
    return F.xxhash64(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "leak_no") -> DataFrame:
    """df with each row's number within its key, from 0, in ``order``; ties in an order of their own that is always the same.

    Rows are dealt out by ranges of (key, order) and sorted there, so a key with many rows is spread over many tasks. The table is written
    once in this order, each row with its place (the task in the upper bits); a key's places in one task are gapless, so its numbers are
    places less its first there, plus its rows in earlier tasks. Null keys are a key of their own."""
    by = [F.col(o) if isinstance(o, str) else o for o in [*keys, *order]] + [_tie(df)]
    placed = Cuts(df.sparkSession)(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__k": F.struct(*keys), "__p": F.shiftright("__at", 33)})
    heads = placed.groupBy("__k", "__p").agg(F.min("__at").alias("__f"), F.count("*").alias("__c"))
    # a key has one row a task here
    earlier = F.sum("__c").over(W.partitionBy("__k").orderBy("__p")) - F.col("__c")
    shift = heads.select("__k", "__p", (earlier - F.col("__f")).alias("__s"))
    return placed.join(shift, ["__k", "__p"]).select(*df.columns, (F.col("__at") + F.col("__s")).cast("int").alias(name))


def capped(df: DataFrame, keys: list[str], order: list[Column | str], most: int, parts: int = PARTS) -> DataFrame:
    """The first ``most`` rows of each key; ties as in ``numbered``. Each of a key's parts is cut to ``most`` first, and Spark
    cuts within tasks before rows move at all, so at most parts * most rows of a key meet. The cap is what the operator means."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    split = df.withColumns({"__t": _tie(df), "__s": F.pmod(_tie(df), F.lit(parts))})
    for group in ([*keys, "__s"], keys):
        split = split.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*by, "__t"))).where(F.col("__n") <= most).drop("__n")
    return split.select(*df.columns)
