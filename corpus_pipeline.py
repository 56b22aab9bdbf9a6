"""A corpus pipeline: language ID, quality rules, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import langid, ngram_join, packing, pii, quality
from leakloom.llm.common import Scratch, free_name
from leakloom.llm.queries import DEMO_KEY, WORD_BPE

#: A row's identity within a stage, in the place of doc_id: rows equal in all of these have one verdict.
ROW = ("doc_id", "text", "lang", "source")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go (all, if no row has a language to learn from); the predicted language replaces a
    missing one. A text of several known languages stays, whatever the top one's share. Each row has its own verdict,
    also with a null or repeated doc_id; equal rows all stay. No text is shuffled."""
    found = langid.identified(docs, langid.fit(docs, ~langid.held_out())).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go. Each row has its own verdict,
    also with a null or repeated doc_id; equal rows all stay. No text is shuffled."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id, null last. Rows with a null doc_id take part as all
    others do; rows that share a doc_id stay apart if their texts do; equal rows count once."""
    a, b = free_name(docs, "_row"), free_name(docs, "_key")  # 128 bits in all
    named = docs.withColumn(a, F.xxhash64(*(x for c in ROW for x in (F.col(c).isNull(), F.col(c)))))
    ids = named.select(F.col(a).alias("doc_id"), "text")
    rows = named.withColumn(b, F.xxhash64(a, "text"))
    found = ngram_join.ngram_jaccard_members(ids)
    # texts without shingles are groups of their own
    group = F.coalesce("component", F.concat_ws(":", "doc_id", "row_key"))
    groups = found.select(F.col("doc_id").alias(a), F.col("row_key").alias(b), group.alias("__group")).distinct()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), a, b)
    first = rows.select(a, b, "doc_id").join(groups, [a, b]).groupBy("__group").agg(F.min(order).alias("__o")).select(F.col(f"__o.{a}").alias(a), F.col(f"__o.{b}").alias(b))
    return rows.join(first, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in all texts; n_chars follows. All rows stay."""
    return pii.pseudonymise(docs, DEMO_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all that is left: one row per piece; rows with null or repeated ids have theirs."""
    return packing.best_fit_pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language_id", language), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("pii", pseudonyms), ("best_fit_packing", packed)]

#: SQL can't express the models and permutations of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes when the next has been written."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
