"""String, entropy and shape functions, Column to Column; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, quoted."""
    return "(?:" + "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def holds(t: Column, words: list[str]) -> Column:
    """Whether any of the words, as they are, is in the text; null for null. A pattern of them costs several times as much."""
    least = [w for w in dict.fromkeys(words) if not any(v in w and v != w for v in words)]
    return reduce(or_, (F.contains(t, F.lit(w)) for w in least))


def entropy(t: Column) -> Column:
    """Shannon entropy in bits of the first 10,000 characters; 0 for null or empty."""
    s = F.left(t, F.lit(10000))
    n = F.length(s).cast("double")
    # equal characters are neighbours in the sorted text
    runs = F.regexp_extract_all(F.concat_ws("", F.sort_array(F.split(s, ""))), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    parts = F.transform(runs, lambda r: F.length(r) / n)
    bits = F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.length(t) > 0, bits).otherwise(0.0)


def has_repetitive_pattern(t: Column) -> Column:
    """A run of three before the end, a repeated prefix of 3 characters or more, or a short alphabet or digit run."""
    n = F.length(t)
    runs = [s[i : i + 3] for s in ("0123456789", "9876543210", "abcdefghijklmnopqrstuvwxyz") for i in range(len(s) - 2)]
    # a text of period k begins with all that follows its first k characters
    tiled = reduce(or_, ((n >= 2 * k) & t.startswith(F.substr(t, F.lit(k + 1))) for k in range(3, 20)))
    short = n.between(6, 7) & holds(F.lower(t), runs)
    return F.coalesce((n >= 6) & (t.rlike(r"(?s)(.)\1{2}.") | tiled | short), F.lit(False))


def looks_like_encoded(t: Column, least_hex: int = 32, least_b64: int = 32) -> Column:
    s = F.trim(t)
    n = F.length(s)
    uuid = (n == 36) & (F.length(F.regexp_replace(s, "[^-]", "")) == 4)
    hexed = (n >= least_hex) & s.rlike("^[0-9a-fA-F]+$")
    dense = (n > 200) & ~s.contains(" ") & (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) / n > 0.95)
    mixed = (s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")) | s.endswith("=")
    return F.coalesce(uuid | hexed | dense | ((n >= least_b64) & s.rlike("^[A-Za-z0-9+/]+={0,2}$") & mixed), F.lit(False))


def is_pure_base64(t: Column) -> Column:
    return F.coalesce((F.length(t) >= 20) & ~F.lower(t).rlike("^(eyj|ghp_|gho_|ghu_|ghs_|akia)") & t.rlike("^[A-Za-z0-9+/]{20,}={0,2}$"), F.lit(False))


def is_known_placeholder(t: Column) -> Column:
    s = F.trim(F.lower(t))
    shape = "^(" + "|".join(R.PLACEHOLDER_PREFIXES) + ")[_-]|[_-](" + "|".join(R.PLACEHOLDER_SUFFIXES) + r")$|^<.*>$|^\[.*\]$|^\{.*\}$|^xxx+$|^\.{3,}$|^\*{3,}$"
    return F.coalesce(s.isin(R.PLACEHOLDERS) | s.rlike(shape), F.lit(False))


def is_known_example_secret(t: Column) -> Column:
    """A secret of published documentation, one inside the text, or over ten characters of one."""
    s = F.trim(F.lower(t))
    hit = F.lit(False)
    for e in R.EXAMPLE_SECRETS:
        hit = hit | s.contains(e) | ((F.length(s) > 10) & F.contains(F.lit(e), s))
    return F.coalesce(hit, F.lit(False))


def contains_any(t: Column, words: list[str]) -> Column:
    """Whether any of the words, none empty, is in the lowered text; false for null."""
    return holds(F.lower(F.coalesce(t, F.lit(""))), words)


def contains_local_host(t: Column) -> Column:
    return contains_any(t, R.LOCAL_HOSTS)


def is_tutorial_repository(name: Column) -> Column:
    return contains_any(name, R.TUTORIAL_MARKS)


def has_meaningful_structure(t: Column) -> Column:
    s = F.trim(t)
    prefix = s.rlike("^(sk_|pk_|rk_|gh[opsu]_|xox|AKIA|ABIA|ACCA|ASIA|eyJ|bearer |Bearer |(api|key|token|secret)[_-]|-----BEGIN)")
    pair = s.rlike(r"(?U)^[\w-]+\s*[:=]\s*.+$")

    def parts(sep: str) -> Column:
        p = F.split(s, sep)
        return F.size(p).between(2, 6) & F.forall(p, lambda x: F.length(x) >= 2)

    return F.coalesce((F.length(t) >= 8) & (prefix | pair | parts("-") | parts("_") | parts(r"\.")), F.lit(False))


def is_random_with_keyword(t: Column, words: list[str], structured: Column | None = None) -> Column:
    """25 characters or more, mixed case without structure, and a keyword inside with letters or digits on both sides."""
    structured = has_meaningful_structure(t) if structured is None else structured
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / F.greatest(letters, F.lit(1))

    def inside(w: str) -> Column:
        at = F.locate(w.lower(), F.lower(t))
        around = F.substr(t, at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.substr(t, at + len(w), F.lit(1)).rlike(r"[\p{L}\p{N}]")
        return (at > 1) & around

    hit = F.lit(False)
    for w in words:
        if len(w) >= 3:
            hit = hit | inside(w)
    return F.coalesce((F.length(t) >= 25) & ~structured & (letters >= 10) & (upper > 0.15) & (upper < 0.85) & hit, F.lit(False))


def semantic_check(t: Column, term: str) -> Column:
    q = one_of([term])
    return F.coalesce(t.rlike(rf"(?iU)\b{q}[\w.-]*\b") & ~t.rlike(rf"(?i)[^a-zA-Z0-9\s]+{q}[^a-zA-Z0-9\s]+"), F.lit(False)).cast("int")


def context_around(t: Column, term: Column, width: int = 50) -> Column:
    """Whole texts of up to 100 characters, else the term with ``width`` characters on each side, or the first 100."""
    pos = F.position(F.lower(term), F.lower(t))
    first, last = F.greatest(pos - width, F.lit(1)), F.least(pos + F.length(term) + width, F.length(t) + 1)
    cut = F.concat(F.when(first > 1, "...").otherwise(""), F.substr(t, first, last - first), F.when(last <= F.length(t), "...").otherwise(""))
    return F.when(F.length(t) <= 100, t).when(pos > 0, cut).otherwise(F.concat(F.left(t, F.lit(100)), F.lit("...")))


def truncated(t: Column, n: int = 100) -> Column:
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def masked(t: Column) -> Column:
    """First and last four characters; values of up to eight are all stars."""
    n = F.length(t)
    return F.when(n > 8, F.concat(F.left(t, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(t, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))


def company_terms(name: Column) -> Column:
    """The name, its words over two characters, initials of all words and of those words; distinct, sorted, two characters or more."""
    low = F.lower(name)
    words = F.filter(F.split(low, r"[\s\-_.,()&]+"), lambda w: w != "")
    stop = ["the", "and", "of", "for", "in", "on", "at", "to", "a", "an"]
    long = F.filter(words, lambda w: F.length(w) > 2)
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.left(w, F.lit(1))), "")
    terms = F.concat(F.array(low), long, F.array(initials(words), initials(F.filter(long, lambda w: ~w.isin(stop)))))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda w: F.length(w) > 1)))


def sanitized_company(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[ ./]", "-"), r"[()]", "")


def relevance(t: Column, terms: Column | list[str]) -> Column:
    """Sum of min(length / 10, 1) over terms that the text contains, 1 at most. Terms known beforehand, a list, cost a fraction:
    Spark doesn't compile lambdas, and lowers the text once for each term in them."""
    low, worth = F.lower(t), lambda w: F.least(F.length(w) / 10.0, F.lit(1.0))
    if isinstance(terms, Column):
        hit = F.filter(terms, lambda w: F.contains(low, F.lower(w)))
        return F.least(F.lit(1.0), F.aggregate(hit, F.lit(0.0), lambda a, w: a + worth(w)))
    return F.least(F.lit(1.0), reduce(add, (F.when(F.contains(low, F.lower(w)), worth(w)).otherwise(0.0) for w in map(F.lit, terms)), F.lit(0.0)))


def dangerous(t: Column) -> Column:
    return F.coalesce(t.rlike(r"(?iU)\b(?:" + "|".join(R.DANGEROUS_WORDS) + r")\b"), F.lit(False))


def scrubbed_remote(t: Column) -> Column:
    """Credentials in a remote's address removed."""
    return F.regexp_replace(t, r"(https?://)[^@/\s]+@", "$1")


def business_category(t: Column, technical: bool = False) -> Column:
    u = F.upper(F.coalesce(t, F.lit("")))
    sql, ssh = ("", "") if technical else ("|SQL", "|SSH")
    return F.when(u.rlike("API|KEY"), "API Keys").when(u.rlike("DATABASE|DB" + sql), "Database Credentials").when(u.rlike("PRIVATE|RSA" + ssh), "Private Keys").when(u.rlike("DEBUG|LOG"), "Debug Information").otherwise("Other")
