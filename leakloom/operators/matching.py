"""Many patterns and many terms against many texts: which patterns match whole keys, which terms texts hold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the pieces that patterns are looked up by, longest first.
PIECES = (6, 2)
#: Patterns without a piece that are tried together, and characters of terms that one automaton is built of.
TOGETHER, PART_CHARS = 100, 4 << 20
#: Rows of found terms that a worker gathers before they leave it.
HITS = 1 << 16


def required_texts(pattern: str) -> list[str]:
    """Texts that all matches of a pattern hold, in lower case; none if that isn't certain.

    Only what stands outside of groups and alternatives counts, and no character that a quantifier may drop."""
    if re.search(r"\\[QE]|\(\?[a-zA-Z]*[xuU]", pattern):
        return []
    found, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, step, text = pattern[i], 1, None
        if c == "\\" and i + 1 < len(pattern):
            step = 2
            text = None if pattern[i + 1].isalnum() else pattern[i + 1]
        elif c == "[":
            step = _class_end(pattern, i) - i
        elif c == "|" and not depth:
            return []
        elif c in "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c not in ".^$*+?{}|":
            text = c
        i += step
        repeat = pattern[i : i + 1] if pattern[i : i + 1] in ("*", "?", "{", "+") else ""
        if text is not None and not depth and repeat in ("", "+"):
            run += text
        if text is None or depth or repeat:
            found.append(run)
            run = ""
        if repeat:
            end = pattern.find("}", i) + 1 if repeat == "{" else i + 1
            i = end or len(pattern)
            while pattern[i : i + 1] in ("?", "+"):  # lazy and possessive forms
                i += 1
    return [t.lower() for t in [*found, run] if t]


def _class_end(pattern: str, i: int) -> int:
    """The place behind a character class that begins at i; a class within it belongs to it."""
    depth, j = 0, i
    while j < len(pattern):
        c = pattern[j]
        if c == "\\":
            j += 1
        elif c == "[":
            depth += 1
            j += pattern[j + 1 : j + 2] == "^"
            j += pattern[j + 1 : j + 2] == "]"  # first in a class it stands for itself
        elif c == "]":
            depth -= 1
            if not depth:
                return j + 1
        j += 1
    return len(pattern)


def _pieces(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))


def pattern_index(patterns: DataFrame) -> DataFrame:
    """term, piece for patterns(term): a piece of PIECES characters that all its matches hold, the one that fewest patterns could have
    had; null where there is none. Pieces are in lower case, so patterns that ignore case are found too."""

    def texts(terms: pd.Series) -> pd.Series:
        return terms.map(required_texts)

    held = patterns.select("term").where("term is not null").distinct().withColumn("texts", F.pandas_udf(texts, "array<string>")("term"))
    long, short = PIECES
    of = lambda n: F.flatten(F.transform("texts", lambda t: F.coalesce(_pieces(t, n), F.array().cast("array<string>"))))
    choice = held.select("term", F.array_distinct(F.when(F.size(of(long)) > 0, of(long)).otherwise(of(short))).alias("ps"))
    each = choice.select("term", F.explode_outer("ps").alias("piece"))
    rare = each.where("piece is not null").groupBy("piece").agg(F.count("*").alias("n"))
    return each.join(rare, "piece", "left").groupBy("term").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))


def matched_patterns(keys: DataFrame, patterns: DataFrame, key: str = "url") -> DataFrame:
    """key, term: each distinct key with the patterns(term) that match the whole of it.

    A key meets a pattern only if it holds the pattern's piece, by an equi-join on pieces; the pattern itself decides. Patterns without a piece
    (such as '.*') are tried on every key, in groups of TOGETHER, as there is nothing to look them up by: their cost is keys times
    such patterns, their number has no limit. A null key matches nothing; a pattern that isn't a valid one is an error."""
    index = pattern_index(patterns)
    names = keys.select(key).where(F.col(key).isNotNull()).distinct()
    low = F.lower(F.col(key))
    none = F.array().cast("array<string>")
    held = names.select(key, F.explode(F.array_distinct(F.concat(*(F.coalesce(_pieces(low, n), none) for n in PIECES)))).alias("piece"))
    met = held.join(index.where("piece is not null"), "piece").select(key, "term")
    loose = index.where("piece is null").select("term")
    group = F.pmod(F.xxhash64("term"), F.lit(1 << 30))
    count = loose.agg(F.ceil(F.count("*") / TOGETHER).cast("int")).first()[0]
    if count:
        groups = loose.withColumn("g", F.pmod(group, F.lit(count)).cast("int"))
        spread = names.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        met = met.unionByName(spread.join(groups, "g").select(key, "term"))
    return met.where(F.rlike(F.col(key), F.concat(F.lit(r"\A(?:"), "term", F.lit(r")\z")))).distinct()


def hits(batches: Iterator[pa.RecordBatch], terms: list[str], key: str, most: int = HITS) -> Iterator[pa.RecordBatch]:
    """terms_in of batches of key and text. Texts become Python's one by one, and rows leave after every ``most`` or the text that
    reaches it, so what a worker holds doesn't grow with what a batch's texts hold."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    automaton.make_automaton()
    for batch in batches:
        keys, texts = batch.columns
        at, rows = [], []

        def out(keys=keys) -> pa.RecordBatch:
            term, first, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(term, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=[key, "term", "first", "n"])

        for i in range(batch.num_rows):
            found: dict[str, list[int]] = {}
            for end, term in automaton.iter(texts[i].as_py()):
                hit = found.setdefault(term, [end - len(term) + 2, 0])
                hit[1] += 1
            at += [i] * len(found)
            rows += [(term, first, n) for term, (first, n) in found.items()]
            if len(rows) >= most:
                yield out()
                at.clear()
                rows.clear()
        if rows:
            yield out()


def terms_in(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, first (from 1), n: a row for each text and each of terms(term) that it holds, whatever the case, with the place of the
    first occurrence and the number of all, also overlapping ones. Places are those in the lower-cased text.

    An automaton goes through a text once for all terms. Terms are cut into parts of about PART_CHARS characters, by their hash; a part
    travels to the workers whole, so its size is bounded, and texts are read once a part. Empty and null terms and texts hold nothing;
    terms equal but for case come once, in lower case."""
    spark = texts.sparkSession
    low = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    parts = -(-low.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0] // PART_CHARS)
    rows = texts.select(F.col(key), F.lower(F.col(text)).alias("__t")).where("__t <> ''")
    schema = f"{rows.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, term string, first long, n long"
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        own = [r.term for r in low.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]
        sent = spark.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return hits(batches, sent.value, key)

        if own:
            out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def first_term(found: DataFrame, priority: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term: of the terms found in a text the one that comes first in priority(term, at)."""
    ranked = found.join(priority.select(F.lower("term").alias("term"), "at"), "term")
    return ranked.groupBy(key).agg(F.min_by("term", F.struct("at", "term")).alias("term"))
