"""Secret classification and repository scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import rules as R
from leakloom.functions import text as T


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def secret_class(rule: Column, match: Column, path: Column) -> Column:
    """struct<type, weight>: the first rule that applies, in fixed order."""
    text, m = F.lower(F.concat_ws(" ", rule, match, path)), F.lower(match)
    marks = "test_ test- _test -test example_ example- _example sample_ demo_ demo- dummy_ fake_ mock_ placeholder".split()
    testing = T.holds(text, marks) & T.holds(text, ["password", "pass", "pwd", "secret", "key", "token"])
    factor = F.when(F.lower(path).rlike("/(tests?|spec|examples?|sample|demo|fixture|mock)/"), 0.3).otherwise(1.0)
    kind = lambda k, w: F.struct(F.lit(k).alias("type"), w.alias("weight"))
    out = F.when(testing, kind("dummy_password", F.lit(0.05))).when(m.contains("akia") | T.holds(text, ["aws_access", "aws_secret"]), kind("aws_key", factor * 0.95))
    out = out.when(m.rlike("gh[pous]_"), kind("github_token", factor * 0.95)).when(m.startswith("eyj") | F.lower(rule).contains("jwt"), kind("jwt_token", factor * 0.8))
    for name, (words, weight) in R.SECRET_TYPES.items():
        w = factor * weight
        out = out.when(T.holds(text, words), kind(name, F.least(w, F.lit(0.1)) if name in ("test_password", "dev_password", "dummy_password") else w))
    return out.when(T.is_pure_base64(match), kind("base64_blob", factor * 0.1)).otherwise(kind("unknown", factor * 0.3))


def context_score(path: Column, before: Column, match: Column, after: Column) -> Column:
    """Additive: words around the match, and what the path says. Not clamped."""
    text, p = F.lower(F.concat_ws(" ", path, before, match, after)), F.lower(path)
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    words = F.array(*(add(text.contains(k), w) for k, w in R.CONTEXT_WEIGHTS.items()))
    score = F.aggregate(words, F.lit(0.0), lambda a, w: a + w)
    score = score + add(P.is_false_positive_path(path), -0.4) + add(p.rlike(r"config|properties|\.env|secret|credential"), 0.2) + add(p.rlike(r"\.prod|production|live|deploy"), 0.25)
    score = score + add(T.contains_any(p, R.DOC_MARKS), -0.3)
    return score + add(text.rlike(r"(#|//|/\*|\*/|<!--|-->|todo:|fixme:)\s*example"), -0.15)


def entropy_score(e: Column, kind: Column) -> Column:
    least = F.coalesce(F.create_map(*(F.lit(x) for kv in R.LEAST_ENTROPY.items() for x in kv))[kind], F.lit(R.LEAST_ENTROPY_ELSE))
    return F.when(e < least, e / least * 0.5).when(e < least + 1, 0.5 + 0.3 * (e - least)).otherwise(F.least(F.lit(1.0), 0.8 + 0.1 * (e - least - 1)))


def format_score(match: Column, kind: Column) -> Column:
    """How well the match has the format of its type."""
    n, low = F.length(match), F.lower(match)
    both = match.rlike(r"\p{L}") & match.rlike(r"[0-9]")
    key = F.when((n >= 32) & both, 0.85).when((n >= 20) & both, 0.7).when((n >= 16) & match.rlike(r"[\p{L}0-9]"), 0.55).when(n < 12, 0.2).otherwise(0.4)
    word = F.when(low.isin(R.COMMON_PASSWORDS), 0.25).when(n < 6, 0.15).when((n >= 12) & match.rlike(r"\p{Lu}") & match.rlike("[0-9]"), 0.75).when(n >= 8, 0.5).otherwise(0.3)
    parts = F.split(match, r"\.")
    jwt = F.when((F.size(parts) == 3) & F.forall(parts, lambda p: F.length(p) > 10), 0.9).when(low.startswith("eyj"), 0.8).otherwise(0.4)
    aws = F.when(match.rlike("^AKIA[A-Z0-9]{16}$"), 0.95).when((n == 40) & match.rlike("^[A-Za-z0-9+/]+$"), 0.85).otherwise(0.4)
    hub = F.when(match.rlike("^gh[pous]_[A-Za-z0-9]{36,}$"), 0.95).when(match.rlike("^gh[pous]_"), 0.8).otherwise(0.3)
    pem = F.when(match.contains("-----BEGIN") & match.contains("-----END"), 0.95).when(n > 200, 0.7).otherwise(0.3)
    strong = F.when(low.isin(R.PLACEHOLDERS), 0.05).when(n >= 16, 0.8).when(n >= 10, 0.6).otherwise(0.3)
    cert = F.when(match.contains("-----BEGIN CERTIFICATE"), 0.9).when(n > 500, 0.7).otherwise(0.4)
    out = F.when(F.coalesce(n, F.lit(0)) == 0, 0.1).when(kind == "private_key", pem).when(kind == "aws_key", aws).when(kind == "github_token", hub).when(kind == "jwt_token", jwt)
    out = out.when(kind.isin("api_key", "access_token", "secret_key"), key).when(kind == "password", word).when(kind.isin("database_password", "prod_password", "admin_password"), strong)
    return out.when(kind.isin("test_password", "dev_password", "dummy_password"), 0.1).when(kind == "certificate", cert).otherwise(0.5)


def validity(match: Column, path: Column, kind: Column, credibility: Column, fake_words: Column | None = None, company_words: list[str] | None = None, bits: Column | None = None, structured: Column | None = None) -> Column:
    """How likely the match is a working secret, 0 to 1; company_words are words of the company looked for.

    kind, bits (its entropy) and structured stand here several times over, and Spark computes each time anew what isn't a column."""
    n, bits, structured = F.length(match), T.entropy(match) if bits is None else bits, T.has_meaningful_structure(match) if structured is None else structured
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    penalty = add(P.is_binary_file(path), 0.6) + add(T.is_known_example_secret(match), 0.5) + add(T.is_known_placeholder(match), 0.5) + add(P.is_template_config(path), 0.3) + add(P.is_mock_path(path), 0.15) + add(T.contains_local_host(match), 0.1)
    penalty = penalty + add(T.looks_like_encoded(match) & ~structured, 0.3) + add(T.has_repetitive_pattern(match), 0.3) + add(P.is_false_positive_path(path), 0.2)
    penalty = penalty + add(T.is_random_with_keyword(match, company_words or [], structured), 0.2)
    base = 0.35 * entropy_score(bits, kind) + 0.35 * format_score(match, kind) + 0.20 * credibility + 0.05 + add(structured, 0.2)
    v = base * F.greatest(F.lit(0.3), 1 - F.least(penalty, F.lit(0.7)))
    if fake_words is not None:
        v = v * F.greatest(F.lit(0.2), 1 - 0.2 * fake_words)
    v = v * F.when(n < 6, 0.3).when((n < 10) & match.rlike(r"^[\p{L}\p{N}]+$"), 0.6).otherwise(1.0)
    v = v * F.when((F.size(F.array_distinct(F.split(match, ""))) <= 2) & (n > 3), 0.1).otherwise(1.0)
    up, down = (F.length(F.regexp_replace(match, rf"[^\p{{{k}}}]", "")) / F.greatest(n, F.lit(1)) for k in ("Lu", "Ll"))
    return clamp(v * F.when((n > 50) & ~structured & up.between(0.2000001, 0.7999999) & down.between(0.2000001, 0.7999999), 0.4).otherwise(1.0))


def repo_credibility(df: DataFrame, as_of: Column) -> Column:
    """From columns company_committer, corporate, all_public, all_foreign, size, stargazers_count, forks_count, contributors_count, fork_penalty, created_at."""
    c = F.col
    small = c("size") < 100
    few = small.cast("int") + ((c("stargazers_count") <= 50) & (c("forks_count") <= 2)).cast("int") + (c("contributors_count") <= 1).cast("int")
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = F.lit(0.5) + F.when(c("company_committer"), 0.5).when(c("corporate"), 0.1).when(c("all_public"), -0.1).otherwise(0.0)
    score = score + F.when(~c("corporate"), F.when(c("size") < 10, -0.1).when(small, -0.05).otherwise(0.0) + add(few >= 2, -0.05)).otherwise(0.0)
    score = score + F.when(c("stargazers_count") >= 5000, -0.1).when((c("stargazers_count") >= 500) | (c("forks_count") >= 100) | (c("contributors_count") >= 20), -0.05).otherwise(0.0)
    score = score - F.coalesce(c("fork_penalty"), F.lit(0.0)) + add(F.coalesce(F.datediff(as_of, c("created_at")), F.lit(0)) > 8 * 365, -0.1) + add(c("all_foreign"), -0.1)
    return clamp(score)


def leak_level(score: Column) -> Column:
    return F.when(score >= 0.7, 2).when(score >= 0.5, 1).otherwise(0)


def path_relevance(paths: Column, tokens: list[str], bad_ending: Column | None = None) -> Column:
    """How far the paths of findings point to a company of these lower-case words, 0 to 1; no path or no word gives 0."""
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)

    def one(p: Column) -> Column:
        parts, score = F.split(p, r"[/\\.]"), F.lit(0.0)
        for t in tokens:
            score = score + F.when(F.array_contains(parts, t), 0.4).when(F.exists(parts, lambda x: x.contains(t)), 0.2).otherwise(0.0)
            score = score + add(p.contains(f"com/{t}") | p.contains(f"com.{t}"), 0.5) + add(p.rlike(T.one_of([t]) + ".*(?:config|properties|credentials|auth|secret|key)"), 0.3)
        score = score + F.when(P.is_binary_file(p), -0.3).when(F.lit(False) if bad_ending is None else bad_ending, -0.5).otherwise(0.0)
        return F.when(P.is_false_positive_path(p), -0.1).when(P.is_framework_path(p), -0.05).otherwise(score)

    low = F.transform(F.filter(paths, lambda p: F.length(p) > 0), F.lower)
    total = F.aggregate(F.transform(low, one), F.lit(0.0), lambda a, x: a + x)
    total = total * F.when(F.size(F.filter(low, P.is_false_positive_path)) > 0.5 * F.size(low), 0.5).otherwise(1.0)
    return F.when(F.size(low) > 0, clamp(total)).otherwise(0.0) if tokens else F.lit(0.0)


def profitability(org: Column, sens: Column, n: Column, company_committer: Column, digits: int = 2) -> Column:
    tp = 0.5 * org + 0.5 * sens
    up = lambda cond, v, t: F.when(cond, F.greatest(t, F.lit(v))).otherwise(t)
    tp = up((n > 0) & (org >= 0.15), 0.5, tp)
    tp = up((n >= 5) & (org >= 0.15), 0.6, tp)
    tp = up((n > 0) & (org < 0.15), 0.15, tp)
    tp = up((n >= 10) & (org < 0.15), 0.25, tp)
    tp = up((sens >= 0.7) & (org >= 0.1), 0.55, tp)
    tp = up((sens >= 0.5) & (org >= 0.1), 0.4, tp)
    return F.round(clamp(up(company_committer, 0.8, tp)), digits)


def verdict(unified: Column, org: Column, sens: Column, tp: Column, fp: Column, cred: Column, insufficient: Column, company_committer: Column) -> Column:
    """struct<result, high_priority>: 0 closed, 4 to send, 5 to scan deeper."""
    low = unified <= 0.2
    false_marks = ~company_committer & (((fp >= 0.8) & (tp <= 0.2) & (sens <= 0.2)) | ((cred < 0.3) & (org < 0.25)) | ((org < 0.05) & (sens <= 0.2)))
    close = ((unified <= 0.1) & (org < 0.1)) | (low & false_marks & insufficient)
    result = F.when(company_committer, 4).when(close, 0).when(low & (false_marks | insufficient), 5).otherwise(4)
    return F.struct(result.alias("result"), F.when(company_committer, True).when(result == 4, unified >= 0.5).otherwise(False).alias("high_priority"))
