"""Analysis of repositories: candidates, their committers and their findings to scores and a verdict.

candidates: repo, repo_name, author_name, dork, company_name, description, topics, size, stargazers_count, forks_count,
contributors_count, commits_count, fork, created_at, country, ai_related (null: no answer of a model), ai_confidence, ai_tp,
ai_severity. committers: repo, name, email. findings: repo, scanner, seq, rule, match, path, meaningful (null: yes).
Children are aggregated by repo before they meet their candidate, so no repo's rows gather in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import paths as P
from leakloom.functions import rules as R
from leakloom.functions import text as T
from leakloom.operators import scoring as S

#: Secret types by their bit in a set of types.
TYPES = [*R.SECRET_TYPES, "base64_blob", "unknown"]
LOW_MASK = sum(1 << TYPES.index(t) for t in R.LOW_VALUE_TYPES)
#: Bits of scanners, in the order in which their findings of one value precede each other.
SCANNERS = list(R.SCANNER_WEIGHTS)


def add(cond: Column, w: float | Column) -> Column:
    """w where the condition holds; 0 where it doesn't or is unknown."""
    return F.when(cond, w).otherwise(0.0)


def full(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rounded(score: Column, digits: int) -> Column:
    return F.least(F.round(score, digits), F.lit(1.0))


def dork_tokens(dork: Column) -> Column:
    return F.filter(F.split(F.lower(full(dork)), r"[\s,._-]+"), lambda t: F.length(t) > 2)


def has_token(text: Column, tokens: Column) -> Column:
    return F.coalesce(F.exists(tokens, lambda t: F.contains(text, t)), F.lit(False))


def company_domain(domain: Column, token: Column) -> Column:
    """Whether the domain is one that a company of this name would have: name or name and suffix before a common ending,
    alone or below other labels; names of over four letters also with a hyphen before or after."""
    stem = F.regexp_extract(domain, r"^(.*)\.(?:com|ru|org|net|io|gov)$", 1)
    ends = reduce(lambda a, s: a | F.endswith(stem, F.concat(token, F.lit(s))), R.COMPANY_SUFFIXES, F.endswith(stem, token))
    return (F.length(token) >= 3) & (ends | ((F.length(token) > 4) & F.contains(stem, F.concat(token, F.lit("-")))))


def email_score(email: Column, tokens: Column) -> Column:
    """1 for a company's own domain, .7 for a domain with one of its words, .2 less for public ones."""
    domain = P.email_domain(F.lower(full(email)))
    part = add(has_token(domain, tokens), 0.7) - add(domain.isin(R.PUBLIC_DOMAINS), 0.2)
    known = (domain != "") & (F.coalesce(F.size(tokens), F.lit(0)) > 0)
    return F.when(~known, 0.0).when(F.exists(tokens, lambda t: company_domain(domain, t)), 1.0).otherwise(F.greatest(part, F.lit(0.0)))


def fork_penalty(fork: Column, commits: Column, forks: Column) -> Column:
    """A fork with over 100 commits and under 2 forks of its own may hold work of its own."""
    return F.when(~F.coalesce(fork, F.lit(False)), 0.0).when((commits > 100) & (forks < 2), 0.2).otherwise(0.4)


def shape_flags(c: Callable[[str], Column], as_of: Column) -> dict[str, Column]:
    """Size, popularity and age of a repository as flags."""
    small, few = c("size") < 100, (c("stargazers_count") <= 50) & (c("forks_count") <= 2)
    votes = sum((x.cast("int") for x in (few, c("contributors_count") <= 1)), small.cast("int"))
    high = (c("stargazers_count") >= 500) | (c("forks_count") >= 100) | (c("contributors_count") >= 20)
    old = F.coalesce(F.datediff(as_of, c("created_at")), F.lit(0)) > 8 * 365
    return {"is_tiny": c("size") < 10, "is_small": small, "is_personal": votes >= 2, "is_popular": high, "is_very_popular": c("stargazers_count") >= 5000, "is_very_old": old}


def has_cyrillic(t: Column) -> Column:
    return F.coalesce(t.rlike("[Ѐ-ӿ]"), F.lit(False))


def foreign_share(t: Column) -> Column:
    """Share of characters of scripts that neither target country writes."""
    return F.regexp_count(full(t), F.lit("[" + "".join(f"{a}-{b}" for a, b in R.FOREIGN_SCRIPTS) + "]")) / F.greatest(F.length(full(t)), F.lit(1))


def committer_signals(committers: DataFrame, candidates: DataFrame) -> DataFrame:
    """By repo with committers: committer_signal (of company and search word, .5 at most), country_signal, corporate,
    all_public, company_committer, all_foreign, people."""
    c = F.col
    of = candidates.select("repo", F.lower(full(c("dork"))).alias("dork"), "country", T.company_terms(full(c("company_name"))).alias("tokens"))
    rows = committers.select("repo", full(c("name")).alias("name"), full(c("email")).alias("email")).join(of, "repo")
    info, mail = F.lower(F.concat_ws(" ", "name", "email")), F.lower("email")
    domain, corporate = P.email_domain(c("email")), P.is_corporate(c("email"))
    signal = add(F.contains(info, c("dork")), 0.05) + add(has_token(info, c("tokens")), 0.1) + 0.4 * email_score(c("email"), c("tokens"))
    abroad = mail.rlike(r"@.+\.(com|org|net|io)$")
    ru = add(has_cyrillic(c("name")), 0.2) + add(mail.endswith(".ru"), 0.2) - add(abroad, 0.1)
    en = add(c("name").rlike("^[A-Za-z ._-]+$"), 0.02) + add(abroad, 0.02)
    native = has_cyrillic(c("name")) | mail.endswith("ru")
    return rows.groupBy("repo").agg(
        F.least(F.sum(signal), F.lit(0.5)).alias("committer_signal"),
        F.sum(F.when(c("country") == "ru", ru).when(c("country") == "en", en).otherwise(0.0)).alias("country_signal"),
        F.bool_or(corporate).alias("corporate"),
        F.every(~corporate).alias("all_public"),
        F.bool_or(corporate & has_token(domain, c("tokens"))).alias("company_committer"),
        F.every((c("country") == "ru") & ~native).alias("all_foreign"),
        F.bool_or((domain != "") & (has_token(F.lower(domain), F.array_union(c("tokens"), dork_tokens(c("dork")))) | (email_score(c("email"), c("tokens")) >= 0.7))).alias("committer_domain"),
        F.countDistinct("name", "email").alias("people"),
    )


def path_score(path: Column, tokens: Column) -> Column:
    """How far one lower-case path points to a company of these words."""
    parts = F.split(path, r"[/\\.]")

    def of(t: Column) -> Column:
        after = F.get(F.split(path, F.concat(F.lit("\\Q"), t, F.lit("\\E")), 2), 1)
        part = F.when(F.array_contains(parts, t), 0.4).when(F.exists(parts, lambda x: F.contains(x, t)), 0.2).otherwise(0.0)
        own = add(F.contains(path, F.concat(F.lit("com/"), t)) | F.contains(path, F.concat(F.lit("com."), t)), 0.5)
        return part + own + add(after.rlike("config|properties|credentials|auth|secret|key"), 0.3)

    hits = F.aggregate(F.transform(tokens, of), F.lit(0.0), lambda a, x: a + x)
    return F.when(P.is_false_positive_path(path), -0.1).when(P.is_framework_path(path), -0.05).otherwise(hits - add(P.is_binary_file(path), 0.3))


def path_signals(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """By repo whose findings have paths: path_score, 0 to 1, halved where over half of the paths are likely false positives."""
    of = candidates.select("repo", T.company_terms(full(F.col("company_name"))).alias("tokens"))
    rows = findings.select("repo", F.lower(full(F.col("path"))).alias("path")).where("path <> ''").join(of, "repo")
    false = F.count_if(P.is_false_positive_path(F.col("path"))) > 0.5 * F.count("*")
    total = F.sum(path_score(F.col("path"), F.col("tokens"))) * F.when(false, 0.5).otherwise(1.0)
    any_token = F.count_if(F.size("tokens") > 0) > 0
    return rows.groupBy("repo").agg(F.when(any_token, S.clamp(total)).otherwise(0.0).alias("path_score"))


def text_signals(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """By repo with findings: whether a word of the company or the search is in a finding's path or match."""
    of = candidates.select("repo", context_tokens().alias("tokens"))
    rows = findings.join(of, "repo")
    text = F.lower(F.concat_ws(" ", full(F.col("path")), full(F.col("match"))))
    return rows.groupBy("repo").agg(F.bool_or(has_token(text, F.col("tokens"))).alias("text_signal"))


def context_tokens() -> Column:
    return F.array_union(T.company_terms(full(F.col("company_name"))), dork_tokens(F.col("dork")))


def relevance_signals(tokens: Column) -> dict[str, Column]:
    """What speaks for (or against) a candidate belonging to the company, by name; the score is their sum."""
    c = F.col
    dork, name, author, text, topics = (F.lower(full(c(x))) for x in ("dork", "repo_name", "author_name", "description", "topics"))
    raw, raw_author, foreign = full(c("description")), full(c("author_name")), foreign_share(c("description"))
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    ru, en = c("country") == "ru", c("country") == "en"
    return {
        "dork_in_repo": add(F.contains(name, dork), 0.25),
        "dork_in_description": add(F.contains(text, dork), 0.15),
        "company_tokens_description": F.least(F.lit(0.16), 0.08 * hits),
        "dork_in_author": add((author != "") & (dork != "") & F.contains(author, dork), 0.25),
        "dork_multi_signal_bonus": add(F.contains(name, dork) & F.contains(author, dork), 0.1),
        "committers": F.coalesce("committer_signal", F.lit(0.0)),
        "company_in_repo_name": add(has_token(name, tokens), 0.3),
        "company_in_description": add(has_token(text, tokens), 0.1),
        "company_in_topics": add(has_token(topics, tokens), 0.05),
        "file_path_relevance": F.coalesce("path_score", F.lit(0.0)) * 0.35,
        "foreign_language_penalty": -F.when(foreign > 0.2, 0.4).when(foreign > 0.05, 0.3).otherwise(0.0),
        "country": F.coalesce("country_signal", F.lit(0.0))
        + add(ru & has_cyrillic(raw_author), 0.2)
        + add(ru & has_cyrillic(raw), 0.2)
        + add(en & raw_author.rlike("^[A-Za-z ._-]+$"), 0.03)
        + add(en & F.trim(raw).rlike("^[A-Za-z0-9 ,._-]+$"), 0.03),
        "ai_positive": add(c("ai_related"), F.coalesce("ai_confidence", F.lit(0.0)) * 0.5 + 0.1),
        "ai_negative": -add(~c("ai_related"), F.coalesce("ai_confidence", F.lit(0.0)) * 0.3 + 0.1),
    }


def organisation_relevance(signals: dict[str, Column], digits: int = 2) -> Column:
    """0 to 1, from signals, company_committer and credibility: a committer of the company lifts it to .75, and the
    repository's credibility weighs less then."""
    company = F.coalesce("company_committer", F.lit(False))
    total = sum(list(signals.values())[1:], next(iter(signals.values())))
    base = F.greatest(F.when(company, F.greatest(total, F.lit(0.75))).otherwise(total), F.lit(0.0))
    return rounded(base * F.when(company, 0.8 + 0.2 * F.col("credibility")).otherwise(0.7 + 0.3 * F.col("credibility")), digits)


def breakdown(signals: dict[str, Column]) -> Column:
    """map<name, value> of the signals that aren't 0."""
    return F.map_filter(F.create_map(*(x for k, v in signals.items() for x in (F.lit(k), F.round(v, 3)))), lambda k, v: v != 0)


def _bit(values: list[str], c: Column) -> Column:
    """The bit of a value of a fixed list, 0 for others."""
    return F.coalesce(F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, 1 << i)))[c], F.lit(0))


def sensitive_data(findings: DataFrame, repos: DataFrame, digits: int = 2) -> DataFrame:
    """repo, sensitive, secrets, false_positives, distinct_values of every row of repos(repo, credibility, company_committer, ai_severity).

    A value (100 characters) that several scanners found counts once, as the scanner of most weight saw it. Findings that
    are marked meaningless count for the number of scanners only; scanners without a weight don't count."""
    c = F.col
    optional = {x: full(c(x)) if x in findings.columns else F.lit("") for x in ("before", "after")}
    kind = S.secret_class(full(c("rule")), full(c("match")), full(c("path")))
    rank = F.create_map(*(F.lit(x) for i, v in enumerate(SCANNERS) for x in (v, i)))[c("scanner")]
    rows = findings.where(c("scanner").isin(SCANNERS)).select("repo", "scanner", "seq", full(c("match")).alias("match"), full(c("path")).alias("path"), kind.alias("k"), rank.alias("rank"), (F.coalesce(c("meaningful").cast("int"), F.lit(1)) != 0).alias("means"), *(v.alias(k) for k, v in optional.items()))
    seen = F.struct("match", "path", "before", "after", c("k.type").alias("type"), c("k.weight").alias("weight"), "rank")
    values = rows.groupBy("repo", F.left("match", F.lit(100)).alias("value")).agg(
        F.count_if("means").alias("n"),
        F.bit_or(F.when(c("means"), _bit(TYPES, c("k.type"))).otherwise(0)).alias("types"),
        F.bit_or(_bit(SCANNERS, c("scanner"))).alias("scanners"),
        F.min_by(seen, F.when(c("means"), F.struct("rank", "seq", "path"))).alias("f"),
    )
    values = values.join(repos.select("repo", "credibility"), "repo")
    m, path, type_ = c("f.match"), c("f.path"), c("f.type")
    e, least = T.entropy(m), F.coalesce(F.create_map(*(F.lit(x) for kv in R.LEAST_ENTROPY.items() for x in kv))[type_], F.lit(R.LEAST_ENTROPY_ELSE))
    valid = S.validity(m, path, type_, c("credibility"))
    weight = c("f.weight") * F.when(T.has_repetitive_pattern(m), 0.3).otherwise(1.0) * F.when(e < least, 0.4).otherwise(1.0)
    base = F.element_at(F.array(*map(F.lit, R.SCANNER_WEIGHTS.values())), c("f.rank") + 1)
    some = c("f").isNotNull()
    false = P.is_binary_file(path) | (e < 0.5 * least) | (valid < 0.1)
    score = F.greatest(F.lit(0.0), base * weight * valid + 0.3 * S.context_score(path, c("f.before"), m, c("f.after")))
    scored = values.select("repo", "n", "types", "scanners", some.alias("some"), (some & false).alias("false"), F.when(some & ~false, score).alias("score"), (some & ~false & T.is_pure_base64(m)).alias("blob"))
    g = scored.groupBy("repo").agg(F.sum("n").alias("n"), F.bit_or("types").alias("types"), F.bit_or("scanners").alias("scanners"), F.count_if("some").alias("distinct_values"), F.count_if("false").alias("fp"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count_if(c("score") > 0.5).alias("high"), F.count_if("blob").alias("blobs"))
    g = repos.select("repo", "company_committer", "ai_severity").join(g, "repo", "left").na.fill(0, ["n", "types", "scanners", "distinct_values", "fp", "total", "high", "blobs"])
    actual, share = c("n") - c("fp"), c("fp") / F.greatest(c("n"), F.lit(1))
    valuable = F.bit_count(c("types").bitwiseAND(F.lit((1 << len(TYPES)) - 1 - LOW_MASK)))
    blobs = c("blobs") / F.greatest(actual, F.lit(1))
    total = c("total") * F.when(share > 0.8, 0.3).when(share > 0.5, 0.6).otherwise(1.0) * F.when((c("types") != 0) & (valuable == 0), 0.2).otherwise(1.0)
    total = total * F.when((actual > 0) & (blobs >= 1), 0.15).when((actual > 0) & (blobs >= 0.7), 0.4).when((actual > 0) & (blobs >= 0.4), 0.7).otherwise(1.0)
    scanners = F.bit_count("scanners")
    normal = F.least(total / 3, F.lit(1.0)) + F.when(valuable > 2, 0.1).when(valuable >= 1, 0.05).otherwise(0.0) + F.least(F.lit(0.2), 0.07 * c("high"))
    normal = normal + F.when(scanners > 2, 0.15).when(scanners >= 2, 0.08).otherwise(0.0) + 0.1 + add(actual >= 3, 0.1)
    normal = F.when(actual > 0, normal).otherwise(0.0) + add(c("ai_severity") > 0.5, 0.1 * c("ai_severity"))
    normal = F.when(F.coalesce("company_committer", F.lit(False)), F.greatest(normal, F.lit(0.5)) + 0.15).otherwise(normal)
    return g.select("repo", rounded(normal, digits).alias("sensitive"), c("n").alias("secrets"), c("fp").alias("false_positives"), "distinct_values")


def secret_stats(findings: DataFrame) -> DataFrame:
    """By repo: total_secrets, by_scanner and by_type as maps, high_entropy_count, low_entropy_count, placeholder_count; meaningless ones count too."""
    c = F.col
    match = full(c("match"))
    kind = S.secret_class(full(c("rule")), match, full(c("path")))["type"]
    rows = findings.where(c("scanner").isin(SCANNERS)).select("repo", "scanner", match.alias("match"), kind.alias("type"))
    least = F.coalesce(F.create_map(*(F.lit(x) for kv in R.LEAST_ENTROPY.items() for x in kv))[c("type")], F.lit(R.LEAST_ENTROPY_ELSE))
    # one row for each scanner and type, so the maps below have few entries
    cells = rows.groupBy("repo", "scanner", "type").agg(F.count("*").alias("n"), F.count_if(T.entropy(c("match")) >= least).alias("high"), F.count_if(T.is_known_placeholder(c("match"))).alias("known"))
    counts = lambda k: cells.groupBy("repo", k).agg(F.sum("n").alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(f"by_{k}"))
    totals = cells.groupBy("repo").agg(F.sum("n").alias("total_secrets"), F.sum("high").alias("high_entropy_count"), F.sum(c("n") - c("high")).alias("low_entropy_count"), F.sum("known").alias("placeholder_count"))
    return totals.join(counts("scanner"), "repo").join(counts("type"), "repo")


def unified_probability(tp: Column, cred: Column, company_committer: Column, corporate: Column, ai_related: Column, ai_confidence: Column, ai_tp: Column, digits: int = 2) -> Column:
    """The incident's probability: profitability, blended with a model's answer where there is one."""
    there, sure = ai_related.isNotNull(), F.coalesce(ai_confidence, F.lit(0.0))
    score = F.when(there & (ai_tp > 0), 0.6 * tp + 0.4 * ai_tp).otherwise(tp)
    score = score * F.when(there & ~ai_related & (sure >= 0.6), F.greatest(F.lit(0.3), 1 - 0.5 * sure)).otherwise(1.0)
    unknown = ~F.coalesce(company_committer, F.lit(False)) & ~F.coalesce(corporate, F.lit(False))
    return F.round(S.clamp(score * F.when(unknown & (cred < 0.35), 0.85).otherwise(1.0)), digits)


def insufficient_context(org: Column, tokens: Column) -> Column:
    """Whether no sign ties a candidate of low relevance to the company or the search; from company_committer,
    committer_domain and text_signal."""
    name, text = (F.lower(full(F.col(x))) for x in ("repo_name", "description"))
    sign = has_token(name, tokens) | has_token(text, tokens) | F.coalesce("committer_domain", F.lit(False)) | F.coalesce("text_signal", F.lit(False))
    return ~F.coalesce("company_committer", F.lit(False)) & (org < 0.25) & ~sign


def _with_signals(candidates: DataFrame, committers: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    df = candidates.join(committer_signals(committers, candidates), "repo", "left").join(path_signals(findings, candidates), "repo", "left").join(text_signals(findings, candidates), "repo", "left")
    df = df.na.fill(False, ["corporate", "all_public", "company_committer", "all_foreign", "committer_domain", "text_signal"])
    df = df.withColumn("fork_penalty", fork_penalty(c("fork"), c("commits_count"), c("forks_count")))
    return df.withColumn("credibility", S.repo_credibility(df, as_of))


def full_analysis(candidates: DataFrame, committers: DataFrame, findings: DataFrame, as_of: Column, digits: int = 2) -> DataFrame:
    """One row per candidate: repo, org_relevance, relevance (its signals), sensitive, secrets, true_positive_chance,
    false_positive_chance, unified_probability, credibility, level, result, high_priority, insufficient, and the flags of shape_flags.

    ``as_of`` is the day that ages are counted to. Without committers or findings a candidate has those of an empty list."""
    c = F.col
    df = _with_signals(candidates, committers, findings, as_of)
    signals, tokens = relevance_signals(T.company_terms(full(c("company_name")))), context_tokens()
    df = df.withColumn("org_relevance", organisation_relevance(signals, digits)).withColumn("relevance", breakdown(signals))
    df = df.join(sensitive_data(findings, df, digits).select("repo", "sensitive", "secrets"), "repo")
    df = df.withColumn("true_positive_chance", S.profitability(c("org_relevance"), c("sensitive"), c("secrets"), c("company_committer"), digits))
    df = df.withColumn("false_positive_chance", F.round(1 - c("true_positive_chance"), digits))
    df = df.withColumn("unified_probability", unified_probability(c("true_positive_chance"), c("credibility"), c("company_committer"), c("corporate"), c("ai_related"), c("ai_confidence"), c("ai_tp"), digits))
    df = df.withColumn("insufficient", insufficient_context(c("org_relevance"), tokens))
    v = S.verdict(c("unified_probability"), c("org_relevance"), c("sensitive"), c("true_positive_chance"), c("false_positive_chance"), c("credibility"), c("insufficient"), c("company_committer"))
    df = df.withColumn("v", v)
    flags = shape_flags(c, as_of)
    return df.select("repo", "org_relevance", "relevance", "sensitive", "secrets", "true_positive_chance", "false_positive_chance", "unified_probability", "credibility", S.leak_level(c("unified_probability")).alias("level"), "v.result", "v.high_priority", "insufficient", *(flags[k].alias(k) for k in ("is_tiny", "is_personal", "is_very_popular", "is_very_old")))


def detailed_analysis(candidates: DataFrame, committers: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    """full_analysis with secret_stats, the company's words, and what is known of committers and repository, for a report."""
    c = F.col
    df = _with_signals(candidates, committers, findings, as_of)
    tokens, flags = T.company_terms(full(c("company_name"))), shape_flags(c, as_of)
    facts = df.select("repo", "company_name", tokens.alias("company_tokens"), F.coalesce("fork", F.lit(False)).alias("is_fork"), F.contains(F.lower(full(c("repo_name"))), F.lower(full(c("dork")))).alias("dork_relevance"), c("corporate").alias("corporate_email_found"), c("company_committer").alias("target_company_email_found"), (c("stargazers_count") > 500).alias("high_popularity"), c("all_public").alias("all_public_emails"), flags["is_small"].alias("is_small"), flags["is_popular"].alias("is_highly_popular"))
    return full_analysis(candidates, committers, findings, as_of).join(facts, "repo").join(secret_stats(findings), "repo", "left")


def corporate_committers(committers: DataFrame, candidates: DataFrame) -> DataFrame:
    """repo, name, email, domain, matches_company of committers at companies; those of the company looked for first."""
    of = candidates.select("repo", T.company_terms(full(F.col("company_name"))).alias("tokens"))
    rows = committers.where(P.is_corporate(F.col("email"))).join(of, "repo")
    domain = P.email_domain(F.col("email"))
    out = rows.select("repo", "name", "email", domain.alias("domain"), has_token(domain, F.col("tokens")).alias("matches_company"), *([] if "id" not in committers.columns else ["id"]))
    return out.orderBy("repo", F.desc("matches_company"), *([] if "id" not in committers.columns else ["id"]), "email")
