"""Stored documents: base64, nested and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded_blob(t: Column) -> Column:
    """VARIANT of a base64 or plain JSON document (also wrapped as b'...'); an empty object if it is neither."""
    raw = F.regexp_replace(t, r"^b'(.*)'$", "$1")
    text = F.try_validate_utf8(F.try_to_binary(raw, F.lit("base64")).cast("string"))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(raw), F.parse_json(F.lit("{}")))


def encoded_blob(c: Column) -> Column:
    return F.base64(F.encode(F.to_json(c), "UTF-8"))


def nested(v: Column, path: str, kind: str, default) -> Column:
    return F.coalesce(F.try_variant_get(v, path, kind), F.lit(default))


def count_of(v: Column) -> Column:
    """totalCount of an object, length of a list, or the number itself; else 0."""
    return F.coalesce(F.try_variant_get(v, "$.totalCount", "int"), F.size(F.try_variant_get(v, "$", "array<variant>")), F.try_variant_get(v, "$", "int"), F.lit(0))


def llm_json(t: Column) -> Column:
    """VARIANT of a model's answer: fences dropped, else the outermost braces."""
    plain = F.regexp_replace(F.trim(t), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


def verdict_document(v: Column) -> Column:
    """The five-part verdict with defaults."""
    return F.struct(
        F.struct(nested(v, "$.company_relevance.is_related", "boolean", False).alias("is_related"), nested(v, "$.company_relevance.confidence", "double", 0.0).alias("confidence")).alias("company_relevance"),
        F.struct(nested(v, "$.severity_assessment.level", "string", "unknown").alias("level"), nested(v, "$.severity_assessment.score", "double", 0.0).alias("score")).alias("severity_assessment"),
        F.struct(nested(v, "$.classification.true_positive_probability", "double", 0.0).alias("true_positive_probability")).alias("classification"),
        nested(v, "$.summary", "string", "").alias("summary"),
        nested(v, "$.recommendations", "string", "").alias("recommendations"),
    )


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


#: Characters that count as a token, what a repository's unknown numbers and texts are stored as.
TOKEN_CHARS = 4
DEFAULTS = {"size": 0, "stargazers_count": 0, "forks_count": 0, "open_issues_count": 0, "subscribers_count": 0, "contributors_count": 0, "commits_count": 0, "commiters_count": 0, "ai_result": -1, "topics": "_", "description": "_"} | {f"has_{k}": 0 for k in ("issues", "projects", "downloads", "wiki", "pages")}


def trimmed(t: Column, tokens: int) -> Column:
    """As much of the text as a budget of tokens has room for, at TOKEN_CHARS a token."""
    return F.left(t, F.lit(tokens * TOKEN_CHARS))


def says(v: Column, phrases: list[str]) -> Column:
    """Whether any phrase is somewhere in a document, whatever the case."""
    low = F.lower(F.to_json(v))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p.lower()))
    return F.coalesce(hit, F.lit(False))


def with_defaults(df: DataFrame) -> DataFrame:
    """Unknown values of the statistics that df has, as they are stored."""
    return df.na.fill({k: v for k, v in DEFAULTS.items() if k in df.columns})


def decoded_text(b: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 if they are none."""
    return F.coalesce(F.try_validate_utf8(b.cast("string")), F.decode(b, "ISO-8859-1"))
