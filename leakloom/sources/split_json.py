"""Records of large JSON captures, read by many tasks: one array of any size, arrays or objects run together, or one a line.

Spark's text reader cuts a file into splits, at braces, so that no task holds a file. What a brace means depends on what stands before it: whether
a string is open, and how deep it lies. A split is therefore read twice. First it tells for both cases, string open or not, how far it goes up or
down, and whether it leaves a string open; the sums of these over the splits before give every split its start. Then it gives the records that lie in it,
and the pieces of those that go on beyond it, which are put together by their order. Nothing is read but by Spark's own readers, so
it works on every file system they know, and for a stream's micro-batches as for a folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Splits whose starts are sent to all tasks: some 100 MB at most; beyond that fragments are dealt out by split.
FEW = 1_000_000
#: Characters of a record that is never closed that are reported.
SHOWN = 1000
#: Characters of a record at most; a longer one is reported as broken, as are all records behind a brace that is never closed.
LONGEST = 64 << 20
_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split begins), value: texts between opening braces, in their order in a split."""
    return placed(spark.read.option("lineSep", "{").text(path))


def placed(lines: DataFrame) -> DataFrame:
    """fragments of a text reader's rows (batch or stream), read with lineSep '{'."""
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _of_splits(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bool, pd.Series, str]]:
    """(row of its split, whether it is the split's first, text) of each fragment; all but a file's first follow a brace."""
    last = None
    for pdf in frames:
        names = [c for c in pdf.columns if c != "value"]
        for row, value in zip(pdf[names].itertuples(index=False, name=None), pdf["value"], strict=True):
            new = row[:2] != last
            last = row[:2]
            yield row, new, value if new and row[1] == 0 else "{" + value


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each split: flips (does it end in the other string state), and how deep it goes if it begins outside or inside of a string."""
    rows: list[list] = []
    for (file, block), new, text in _of_splits(frames):
        if new:
            rows.append([file, block, False, 0, 0, None])
        r = rows[-1]
        if r[5] is None and text.strip():
            r[5] = text.strip()[0] == "["
        for m in _TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                r[2] = not r[2]
            elif c in "{[":
                r[4 if r[2] else 3] += 1
            elif c in "}]":
                r[4 if r[2] else 3] -= 1
    yield pd.DataFrame(rows, columns=["file", "block", "flips", "outside", "inside", "array"]).astype({"array": "boolean"})


def _starts(parts: DataFrame) -> DataFrame:
    """file, block, quoted, depth, base: each split's start, by sums over the splits before it. A file has few: one for each part that a task reads."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    quoted = parts.withColumn("quoted", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    # counted with a string open, what is outside of strings is what was counted as inside
    deep = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    depth = quoted.withColumn("depth", F.coalesce(F.sum(deep).over(before), F.lit(0)))
    array = F.first("array", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return depth.select("file", "block", "quoted", "depth", F.coalesce(array, F.lit(False)).cast("int").alias("base"))


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 'whole' of each record in a split; 'end', 'middle' and 'begin' of those that reach beyond it."""
    out: list[tuple] = []
    split = quoted = depth = base = None
    open_, whole_split, held, size, nth = False, False, [], 0, 0  # whole_split: the open record began in an earlier split

    def hold(text: str) -> None:
        nonlocal size
        if size <= LONGEST:
            held.append(text)
        size += len(text)

    def close(kind: str) -> None:
        nonlocal held, size, nth
        text = "".join(held)
        out.append((*split, nth, kind, text[:SHOWN] if size > LONGEST else text, size > LONGEST))
        held, size, nth = [], 0, nth + 1

    def leave() -> None:
        if split is not None and open_:
            close("middle" if whole_split else "begin")

    for (file, block, q, d, b), new, text in _of_splits(frames):
        if new:
            leave()
            split, quoted, depth, base = (file, block), q, d, b
            open_, held, size, nth = depth > base, [], 0, 0
            whole_split = open_
            yield pd.DataFrame(out, columns=["file", "block", "nth", "kind", "json", "long"])
            out = []
        at = 0
        for m in _TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                quoted = not quoted
            elif quoted or c[0] == "\\":
                continue
            elif c in "{[":
                if depth == base:
                    at, open_ = m.start(), True
                depth += 1
            else:
                depth -= 1
                if depth == base and open_:
                    hold(text[at : m.end()])
                    close("end" if whole_split else "whole")
                    open_ = whole_split = False
        if open_:
            hold(text[at:])
    leave()
    yield pd.DataFrame(out, columns=["file", "block", "nth", "kind", "json", "long"])


def records_of(parts: DataFrame) -> DataFrame:
    """file, block, nth, json, broken of fragments (a table's or a micro-batch's): the records in the order of (block, nth) of where they begin.

    Records are the objects (or arrays) of a file's outermost array, or the outermost ones of a file that doesn't begin with an array. One that
    isn't valid JSON is broken, as is one that its file doesn't close; of the latter SHOWN characters are kept if it is longer than LONGEST. Files
    without a record give no row."""
    ends = parts.mapInPandas(_ends, "file string, block long, flips boolean, outside long, inside long, array boolean")
    starts = _starts(ends)
    if starts.count() <= FEW:
        begun = parts.join(F.broadcast(starts), ["file", "block"])  # keeps the order of fragments
    else:
        begun = parts.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = begun.select("file", "block", "quoted", "depth", "base", "value").mapInPandas(_pieces, "file string, block long, nth int, kind string, json string, long boolean")
    whole = pieces.where("kind = 'whole'").select("file", "block", "nth", "json", F.lit(True).alias("closed"), "long")
    order = W.partitionBy("file").orderBy("block", "nth")
    cut = pieces.where("kind <> 'whole'").withColumn("r", F.sum((F.col("kind") == "begin").cast("int")).over(order))
    rows = F.array_sort(F.collect_list(F.struct("block", "nth", "json")))
    joined = cut.groupBy("file", "r").agg(rows.alias("ps"), F.bool_or(F.col("kind") == "end").alias("closed"), F.bool_or("long").alias("long"))
    joined = joined.select("file", F.get("ps", F.lit(0))["block"].alias("block"), F.get("ps", F.lit(0))["nth"].alias("nth"), F.array_join(F.col("ps.json"), "").alias("json"), "closed", "long")
    every = whole.unionByName(joined)
    broken = ~F.col("closed") | F.col("long") | F.try_parse_json("json").isNull()
    shown = F.when(F.col("closed") & ~F.col("long"), F.col("json")).otherwise(F.left("json", F.lit(SHOWN)))
    return every.select("file", "block", "nth", shown.alias("json"), broken.alias("broken"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """records_of the files of a path."""
    return records_of(fragments(spark, path))
