"""Path and address functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import contains_any, one_of


def is_binary_file(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(?i)\.(" + "|".join(R.BINARY_ENDINGS) + ")$"), F.lit(False))


def matches_parts(path: Column, parts: list[str]) -> Column:
    """Marks of over five characters anywhere, shorter ones as a component of the path."""
    low = F.lower(path)
    long, short = [p for p in parts if len(p) > 5], one_of([p for p in parts if len(p) <= 5])
    return F.coalesce(low.rlike(rf"{one_of(long)}|[/\\]{short}[/\\.]|^{short}[/\\.]|[/\\]{short}$"), F.lit(False))


def is_mock_path(path: Column) -> Column:
    return matches_parts(path, R.MOCK_PATHS)


def is_false_positive_path(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    named = name.rlike(r"^(test_|example|sample|demo|mock|fixture)|_test\.|\.test\.|\.spec\.|_mock\.|_stub\.")
    return F.coalesce(matches_parts(path, R.FALSE_PATHS) | is_mock_path(path) | named, F.lit(False))


def is_template_config(path: Column) -> Column:
    return contains_any(path, R.TEMPLATE_MARKS)


def is_framework_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(rf"[/\\]{one_of(R.FRAMEWORKS)}[/\\]"), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))


def valid_repo_host(url: Column) -> Column:
    return F.coalesce(host(url).rlike(r"^([^/]+\.)?(gist\.)?github\.com$"), F.lit(False))


def valid_listed_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://(gist\.)?github\.com/[^/]+/.+"), F.lit(False))


def normalised_repo(url: Column) -> Column:
    tail = F.slice(F.split(F.element_at(F.split(url, r"github\.com/"), -1), "/"), 1, 2)
    return F.concat(F.lit("https://"), F.when(url.contains("gist"), "gist.github.com").otherwise("github.com"), F.lit("/"), F.array_join(tail, "/"))


def platform(url: Column) -> Column:
    return F.when(url.contains("github.com"), "GitHub").when(url.contains("gitlab.com"), "GitLab").when(url.contains("bitbucket.org"), "Bitbucket").otherwise("Other")


def email_domain(e: Column) -> Column:
    return F.when(e.contains("@"), F.lower(F.trim(F.element_at(F.split(e, "@"), -1)))).otherwise("")


def is_public_domain(d: Column) -> Column:
    return d.isin(R.PUBLIC_DOMAINS) | contains_any(d, R.NOREPLY_MARKS)


def is_corporate(email: Column) -> Column:
    return (email_domain(email) != "") & ~is_public_domain(email_domain(email))
