"""Search, fetch and scan as one stream: candidates meet the files that were fetched for them, and findings go to the store.

Each stage is a transformation that holds for tables and streams alike; a stream's state is bounded by its watermarks. What
a micro-batch gives is published as one snapshot with the batch's number, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakloom.functions import text as T
from leakloom.operators import findings as N
from leakloom.operators.snapshots import Store
from leakloom.operators.store import MOST_KB

from . import ingest


def searched(candidates: DataFrame, known: DataFrame, lateness: str = "1 day") -> DataFrame:
    """candidates(repo, found_at, size) that aren't known(repo), each repository once (of a stream: within the watermark), and small enough to be fetched."""
    small = candidates.where(F.coalesce(F.col("size") <= MOST_KB, F.lit(False)))
    if candidates.isStreaming:
        return ingest.new_candidates(small, known, "repo", "found_at", lateness)
    return small.join(known.select("repo").distinct(), "repo", "left_anti").groupBy("repo").agg(F.min_by(F.struct("found_at", "size"), "found_at").alias("c")).select("repo", "c.*")


def fetched(candidates: DataFrame, files: DataFrame, within: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """files(repo, path, text, read_at) of candidates, read no later than ``within`` after they were found; of a stream's candidates and files
    those are forgotten that can't meet any more."""
    f = files.withColumnRenamed("repo", "file_repo")
    f = f.withWatermark("read_at", lateness) if f.isStreaming else f
    due = (F.col("repo") == F.col("file_repo")) & (F.col("read_at") >= F.col("found_at")) & (F.col("read_at") <= F.col("found_at") + F.expr(f"interval {within}"))
    return candidates.join(f, due).select("repo", "path", "text", "found_at", "read_at")


def scanned(files: DataFrame, terms: list[str]) -> DataFrame:
    """repo, path, line_no, term, context: the lines of text files that hold a term; stateless, so findings keep all lines: caps are the report's."""
    p = N.term_pattern(terms)
    lines = files.where(N.is_text_file(F.col("path")) & ~N.is_pruned(F.col("path"))).select("repo", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    text = F.trim("text")
    hits = lines.where(F.length(text).between(1, 1000) & text.rlike(p)).withColumn("term", F.regexp_extract(text, p, 0))
    return hits.select("repo", "path", "line_no", "term", T.context_around(text, F.col("term")).alias("context"))


def run(candidates: DataFrame, files: DataFrame, known: DataFrame, terms: list[str], store: Store, checkpoint: str) -> StreamingQuery:
    """The three stages of two streams into the store's tables ``findings`` and ``scanned``; all that is there is worked off."""

    def sink(batch: DataFrame, number: int) -> None:
        store.publish("stages", number, lambda tables: {}, {"findings": scanned(batch, terms), "scanned": batch.select("repo", "path")})

    return ingest.flushed(fetched(searched(candidates, known), files), sink, checkpoint)
