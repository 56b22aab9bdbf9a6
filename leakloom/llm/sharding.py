"""Contiguous balanced shards by global byte-size prefix sums, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes that a row counts besides its text.
OVERHEAD = 8
#: Ranges whose totals are small enough to broadcast (a few numbers each; a range has rows of few shards).
RANGES = 100_000


#: A group of equal texts stays in one shard if it has at most this part of a shard's bytes.
WHOLE = 100


def shard_by_bytes(documents: DataFrame, shards: int = 24, groups: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in one order, cut at equal byte targets.

    The order is that of doc_id (equal ids by checksum and size), or with ``groups`` that of the texts' MD5, then doc_id, so
    that equal texts are neighbours. Rows are sorted into ranges; each range sends its totals (one row a range) and gets the
    sums before it, so every row knows the bytes before it over all rows. The shard is where the row's middle byte falls among
    ``shards`` equal targets, so each shard differs from the target by at most the largest row. With ``groups``, one of at most
    a WHOLE-th of a target goes whole where its own middle byte falls, and a larger one is cut where a target falls into it:
    at most shards - 1 groups are split, and a shard differs by at most that part of the target or the largest row.
    Null ids sort first; a null text has no bytes and is of one group with the empty one; repeated rows are placed each.
    An empty table gives no rows; other columns are ignored."""
    scratch = Scratch(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.unhex(F.md5(text)) if groups else F.lit(None).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), own.alias("group"))
    by = ["group"] * groups + ["doc_id", "text_crc32", "size"]
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranges = scratch.keep(ranges.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "ranges")
    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = totals.withColumn("before", F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")).withColumn("all", F.sum("bytes").over(W.partitionBy()))
    small = F.broadcast if before.count() <= RANGES else lambda df: df
    upto = F.sum("size").over(W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    placed = ranges.withColumn("upto", upto).join(small(before.select("part", "before", "all")), "part").withColumn("upto", F.col("upto") + F.col("before"))
    # middle byte in half bytes: 2 * upto - size, of 2 * all
    middle = 2 * F.col("upto") - F.col("size")
    if groups:
        whole = placed.groupBy("group").agg(F.count("*").alias("n"), F.min(F.col("upto") - F.col("size")).alias("first"), F.sum("size").alias("bytes"), F.max("all").alias("sum"))
        whole = whole.where((F.col("n") > 1) & (F.col("bytes") * WHOLE * shards <= F.col("sum"))).select("group", "first", "bytes")
        placed = placed.join(whole, "group", "left")
        middle = F.when(F.col("first").isNotNull(), 2 * F.col("first") + F.col("bytes")).otherwise(middle)
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / (F.col("all") * 2)), F.lit(shards - 1)).cast("int")
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", "part", "nth", shard.alias("shard")), "placed")
    scratch.drop("ranges")
    # slots: rows of the shard in earlier ranges, plus those before it in its own
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("earlier", F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    nth = F.row_number().over(W.partitionBy("part", "shard").orderBy("nth")) - 1
    cells = small(counts.select("shard", "part", "earlier"))
    return placed.withColumn("own", nth).join(cells, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("earlier") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
