"""Committers whose name and e-mail are both new, in order, without going through a repository's people one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import Cuts
from .tables import first_seen

#: Rounds before chains are followed by doubling.
PLAIN = 2


def committers_first_seen(df: DataFrame) -> DataFrame:
    """Per repo, the rows whose name and e-mail no row that counts has had before, in order of seq (ties: name, then e-mail).

    That is a greedy matching of names and e-mails, found in rounds: a row that is the first of both its name and its e-mail
    counts, and all others of that name or e-mail are out. In random orders few rounds are enough. A chain, where each row waits for just one
    before it, would take a round for each row: from the third round on such rows point at the one they wait for, and
    doubling the pointers finds the chain's head and whether they are an even number of steps from it, in which case they
    count too. All by joins and mergeable aggregates; a null name or e-mail is one like others, equal rows count once."""
    cuts = Cuts(df.sparkSession)
    once = first_seen(df, ["repo", "name", "email"], ["seq"])
    # columns of df come back at the end: rounds carry keys and order alone
    rest = cuts(once.select(F.struct("repo", "name").alias("n"), F.struct("repo", "email").alias("m"), F.struct("repo", "seq", "name", "email").alias("o")))
    found, r = [], 0
    while r == 0 or not rest.isEmpty():
        one = rest.join(rest.groupBy("n").agg(F.min("o").alias("n1")), "n").join(rest.groupBy("m").agg(F.min("o").alias("m1")), "m")
        one = cuts(one)
        heads = one.where("o = n1 and o = m1").select("n", "m", "o")
        if r >= PLAIN:
            heads = heads.unionByName(_chained(one, heads, cuts))
        heads = cuts(heads)
        found.append(heads)
        left = rest.join(heads.select("n"), "n", "left_anti").join(heads.select("m"), "m", "left_anti")
        rest, r = cuts(left), r + 1
    kept = found[0].select("o")
    for f in found[1:]:
        kept = kept.unionByName(f.select("o"))
    back = once.withColumn("o", F.struct("repo", "seq", "name", "email")).join(kept, "o", "left_semi")
    return back.select(*df.columns)


def _chained(one: DataFrame, heads: DataFrame, cuts: Cuts) -> DataFrame:
    """n, m, o of the rows that count because they are an even number of steps behind a head; one: all rows with the first of their name and e-mail."""
    second = lambda k: one.where(f"o > {k}1").groupBy(k).agg(F.min("o").alias(f"{k}2"))
    both = one.join(second("n"), "n", "left").join(second("m"), "m", "left")
    # first of the name and second of the e-mail, or the other way round: just one row is before
    waits = F.when(F.expr("o = n1 and o = m2"), F.col("m1")).when(F.expr("o = m1 and o = n2"), F.col("n1"))
    steps = cuts(both.select("n", "m", "o", waits.alias("p"), F.lit(True).alias("odd")).where("p is not null"))
    while True:
        ahead = steps.select(F.col("o").alias("p"), F.col("p").alias("p2"), F.col("odd").alias("odd2"))
        joined = cuts(steps.join(ahead, "p", "left"))
        if joined.where("p2 is not null").isEmpty():
            break
        steps = joined.select("n", "m", "o", F.coalesce("p2", "p").alias("p"), F.when(F.col("p2").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("odd2")).alias("odd"))
    return steps.where("not odd").join(heads.select(F.col("o").alias("p")), "p", "left_semi").select("n", "m", "o")
