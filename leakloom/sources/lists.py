"""Lists and settings that a run starts from: search terms, exclusions, processed addresses, configuration."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.operators.cuts import Cuts
from leakloom.operators.matching import matched_patterns

#: Terms that others are combined with at most: they become an array in the plan.
MOST_TERMS = 1000
#: Excluded addresses that are sent to all tasks at most: some ten megabytes.
FEW_KEYS = 100_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """term, at: the lines of a list that aren't blank, without blanks at their end."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("term"), F.monotonically_increasing_id().alias("at"))
    return rows.where("term <> ''")


def literal(pattern):
    """The text that a pattern without wildcards stands for; null for other patterns."""
    plain = pattern.rlike(r"^(?:[^\\.^$*+?()\[\]{}|]|\\[^A-Za-z0-9])*$")
    return F.when(plain, F.regexp_replace(pattern, r"\\(.)", "$1"))


def unexcluded(candidates: DataFrame, patterns: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose whole key no pattern(term) matches, for any number of patterns: quoted texts by an anti-join, those with
    wildcards through an index of the pieces that their matches hold."""
    texts = patterns.select(literal(F.col("term")).alias(key)).where(F.col(key).isNotNull()).distinct()
    out = candidates.join(texts, key, "left_anti").select(*candidates.columns)
    wild = patterns.where(F.col("term").isNotNull() & literal(F.col("term")).isNull())
    gone = Cuts(out.sparkSession)(matched_patterns(out, wild, key).select(key).distinct())
    few = gone.count() <= FEW_KEYS  # then candidates stay where they are
    return out.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*candidates.columns)


def with_exclusions(patterns: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    """patterns(term) and those that match just the given addresses, each once."""
    new = urls.select(F.regexp_replace(key, r"([^A-Za-z0-9_])", r"\\$1").alias("term")).distinct()
    return patterns.select("term").unionByName(new.join(patterns, "term", "left_anti").select("term"))


def unprocessed(listed: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """Listed addresses that no run has marked; marks are a table of their own, appended to."""
    return listed.join(processed.select(key).distinct(), key, "left_anti")


def marked(processed: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    return processed.select(key).unionByName(unprocessed(urls.select(key).distinct(), processed, key))


def product_terms(terms: DataFrame, base: list[str], skip: int = 3) -> DataFrame:
    """company_id, term: each company's terms from the fourth on (at counts from 0), followed by each base term; those it has already don't come again."""
    rows = terms.where(F.col("at") >= skip).select("company_id", F.explode(F.array(*(F.concat(F.col("term"), F.lit(" " + b)) for b in base))).alias("term"))
    return rows.distinct().join(terms.select("company_id", "term").distinct(), ["company_id", "term"], "left_anti")


def products(terms: DataFrame, others: DataFrame, column: str = "term", most: int = MOST_TERMS) -> DataFrame:
    """term: each term followed by each of the others, once. The others are a short list; more than ``most`` are an error."""
    second = [r[0] for r in others.select(column).distinct().limit(most + 1).collect()]
    if len(second) > most:
        raise ValueError(f"more than {most} terms to combine with")
    return terms.select(F.explode(F.array(*(F.concat(F.col(column), F.lit(f" {x}")) for x in sorted(second)))).alias("term")).distinct() if second else terms.select(F.col(column).alias("term")).limit(0)


def overridden(config: DataFrame, stored: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows of the configuration, but the stored ones of every company that has such."""
    return stored.unionByName(config.join(stored.select(key).distinct(), key, "left_anti").select(*stored.columns))


def settings(config: str | None = None, env: str | None = None, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of a JSON file, over them those of a .env file, over them the environment's of the same names.

    In a .env file blank lines and those of # count nothing; ``export`` and quotes around a value are dropped."""
    out: dict[str, str] = {}
    if config and os.path.exists(config):
        with open(config, encoding="utf-8") as f:
            out |= json.load(f)
    if env and os.path.exists(env):
        with open(env, encoding="utf-8") as f:
            for m in re.finditer(r"^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(.*?)[ \t]*$", f.read(), re.M):
                out[m[1]] = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "'\"" else m[2]
    given = os.environ if environ is None else environ
    return {k: given.get(k, v) for k, v in out.items()}
