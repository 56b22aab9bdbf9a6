"""Secret scans over an incremental blob ledger, with built-in functions only.

Every version of every path is content-addressed (SHA-256 of its UTF-8). A rule set has versioned rules; the
ledger holds what each (blob, rule, version) gave. Only blobs with a pair that the ledger lacks are scanned, each
once, and findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    version: int
    #: one capture group around the whole match
    pattern: str
    #: SQL over ``m``, the match: which matches count
    keep: str
    #: cheap SQL over ``text`` that no text with a match fails
    hint: str


#: The order is the order of kinds at equal starts.
RULES = (
    Rule("assign", 1, r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(m, '^[A-Za-z_]+["\\x27]?\\x20*[:=]\\x20*["\\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12""", "text rlike '(?i)passw|secret|token|api_?key'"),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", "length(m) >= 18", "contains(text, 'AKIA')"),
    Rule("hex", 1, r"([0-9a-f]{16,})", "true", "text rlike '[0-9a-f]{16}'"),
    Rule("pem", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "true", "contains(text, '-----BEGIN ')"),
    Rule("hub", 1, r"(gh[opsu]_[A-Za-z0-9]{36,})", "true", "text rlike 'gh[opsu]_'"),
)
BASE = ("assign", "access", "hex")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPANS = "array<struct<start: int, kind_no: int, kind: string, stop: int>>"
#: Matches whose places are summed up together: appending copies an array, so long lists are built in two levels.
CHUNK = 256


def rule_spans(rule: Rule) -> Column:
    """array<struct<start, kind_no, kind, stop>> of a rule's leftmost non-overlapping matches in ``text``, in code points.

    Matches and the gaps between them (a split at the pattern) give every start as a running sum of lengths, first within
    chunks of matches, then over chunks."""
    p, kind_no = _lit(rule.pattern), [r.kind for r in RULES].index(rule.kind) if rule in RULES else 99
    gaps, found = f"transform(split(text, {p}, -1), g -> length(g))", f"regexp_extract_all(text, {p}, 1)"
    kept = rule.keep.replace("m,", "x.m,").replace("(m)", "(x.m)")
    within = f"""aggregate(chunk, struct(0 AS at, cast(array() AS {_SPANS}) AS spans),
        (a, x) -> struct(a.at + x.g + coalesce(length(x.m), 0) AS at,
            if(x.m IS NOT NULL AND ({kept}), array_append(a.spans, struct(a.at + x.g AS start, {kind_no} AS kind_no, '{rule.kind}' AS kind, a.at + x.g + length(x.m) AS stop)), a.spans) AS spans))"""
    chunks = f"transform(transform(array(zip_with({gaps}, {found}, (g, m) -> struct(g AS g, m AS m))), z -> transform(sequence(0, (size(z) - 1) div {CHUNK}), c -> slice(z, c * {CHUNK} + 1, {CHUNK})))[0], chunk -> {within})"
    sums = f"""flatten(aggregate({chunks}, struct(0 AS at, cast(array() AS array<{_SPANS}>) AS parts),
        (a, r) -> struct(a.at + r.at AS at, array_append(a.parts, transform(r.spans, s -> struct(a.at + s.start AS start, s.kind_no AS kind_no, s.kind AS kind, a.at + s.stop AS stop))) AS parts), a -> a.parts))"""
    return F.expr(f"if({rule.hint}, {sums}, cast(array() AS {_SPANS}))")


def scan_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger lacks: rows blob, rule, version, spans for every unseen (blob, rule version) pair of versions(text).

    Append them to the ledger. Null text is the empty text. Copies of a text are one blob and are scanned once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        pending = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
        pending = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    new = [F.when(~F.array_contains("done", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), rule_spans(r).alias("spans"))) for r in rules]
    return pending.select("blob", F.explode(F.array_compact(F.array(*new))).alias("f")).select("blob", "f.*")


def secret_findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob, spans: each path's version with all findings of its blob, sorted by start, then kind.

    versions(doc_id, text): a row per path version; repeated rows and null ids stay; a blob without findings gives an
    empty array; other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    paths = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"))
    found = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,stop:int>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")
