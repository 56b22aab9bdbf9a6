"""Runs: which incidents to look at, in which order, and what a run changes. Fetching, cloning and scanning are other programs;
a job says what they have to do, or takes what they brought."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.operators import analysis as A
from leakloom.operators import tables as D
from leakloom.sources import lists as L

#: Status of incidents that wait for a deep scan, and of those that are looked at again; addresses of a batch;
#: tries of a step, and the longest wait before the next in seconds.
DEEP, AGAIN, BATCH, TRIES, LONGEST = 5, 4, 5, 3, 300


def listed(urls: DataFrame, known: DataFrame, processed: DataFrame, patterns: DataFrame) -> DataFrame:
    """url, repo: listed addresses to scan: valid, neither known, processed nor excluded, each repository once."""
    rows = L.unprocessed(urls.where(P.valid_listed_url(F.col("url"))), processed).withColumn("repo", P.normalised_repo(F.col("url")))
    new = D.unseen(rows, known.select(P.normalised_repo(F.col("url")).alias("repo")), "repo")
    return L.unexcluded(new, patterns, "repo").groupBy("repo").agg(F.min("url").alias("url")).select("url", "repo")


def waiting(leaks: DataFrame, status: int) -> DataFrame:
    """id, url, batch of incidents of a status on a host that can be scanned; the last incident of an address counts, and
    batches are BATCH addresses in order of id within a hundred thousand ids."""
    last = D.latest(leaks.select("url", "result", "id"), "url", "id")
    rows = last.where((F.col("result") == status) & P.valid_repo_host(F.col("url"))).withColumn("block", F.floor(F.col("id") / 100_000))
    own = D.numbered(rows, ["block"], ["id"], "nth")
    return own.select("id", "url", F.concat_ws("-", "block", F.floor(F.col("nth") / BATCH)).alias("batch"))


def schedule(leaks: DataFrame, lists: DataFrame | None = None) -> Iterator[tuple[str, DataFrame]]:
    """What a run does, in order: the list (if there is one), deep scans, second looks."""
    if lists is not None:
        yield "list", lists
    yield "deep", waiting(leaks, DEEP)
    yield "again", waiting(leaks, AGAIN)


def with_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with a model's captured answers (repo, ai_related, ai_confidence, ai_tp, ai_severity), unknown where there are none,
    and ai_result: 1 for a leak, 0 for none, -1 for no answer."""
    names = ["ai_related", "ai_confidence", "ai_tp", "ai_severity"]
    both = candidates.drop(*names).join(answers.select("repo", *names), "repo", "left")
    return both.withColumn("ai_result", F.coalesce(F.col("ai_related").cast("int"), F.lit(-1)))


def triaged(candidates: DataFrame, committers: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    """repo, level, result, high_priority of analysed candidates, as the store takes them."""
    return A.full_analysis(candidates, committers, findings, as_of).select("repo", "level", "result", "high_priority")


def in_turn(tokens: list[str]) -> Iterator[str]:
    """Tokens one after the other, again and again."""
    if not tokens:
        raise ValueError("no tokens")
    while True:
        yield from tokens


def retried(step: Callable[[], object], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> object:
    """What the step gives; after an error it waits 1, 2, 4 ... seconds (LONGEST at most) and tries again, ``tries`` times in all."""
    for n in range(tries):
        try:
            return step()
        except (OSError, ConnectionError):
            if n + 1 == tries:
                raise
            wait(min(2.0**n, LONGEST))
    raise ValueError("tries must be positive")
