"""The status text of a candidate: what was found and how it was judged, line by line, in one of two languages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakloom.functions.messages import MESSAGES
from leakloom.functions.rules import SCANNERS

#: Characters of a description, of a summary, and committers that a status shows.
DESCRIPTION, SUMMARY, PEOPLE = 50, 200, 5
NOTHING = ("", "_")


def two_decimals(v: Column) -> Column:
    """A number (below 10^12) as text with two decimals, rounded as it is stored: 0.145 is a little less than that and gives 0.14, and of
    two that are as near (0.125) the even one counts."""
    x = F.abs(v.cast("double"))
    n = F.floor(x * 100 - F.lit(0.25))  # the wanted one or the one below it, give or take the rounding of this very product
    n = F.greatest(F.when(x * 100 - n > 1, n + 1).otherwise(n), F.lit(0))
    wide = x * F.lit(float((1 << 27) + 1))
    high = wide - (wide - x)  # 26 bits of x; products of these and of the rest with small numbers are exact
    over = (high * 200 - (2 * n + 1).cast("double")) + (x - high) * 200
    near = (n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)).cast("long")
    sign = F.when(v < 0, "-").otherwise("")
    return F.concat(sign, F.floor(near / 100).cast("long").cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"))


def message(key: str, lang: str = "ru", **values: Column) -> Column:
    """A message with its places filled; numbers with two decimals where it says so, an unknown key is empty."""
    template = MESSAGES.get(lang, MESSAGES["en"]).get(key, "")
    parts = []
    for text, name, form in re.findall(r"([^{]+)|\{(\w+)(:\.2f)?\}", template):
        if text:
            parts.append(F.lit(text))
        else:
            v = values[name]
            parts.append(F.coalesce((two_decimals(v) if form else v.cast("string")), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def cut(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def status(c, lang: str = "ru") -> Column:
    """The whole text, distinct lines in order, from columns that ``c`` gives by name: unified_probability, credibility, is_tiny,
    is_personal, is_very_popular, obj_type, dork, description, topics, committers (array of 'name/address'), corporate (array of
    structs name, email, domain, matches_company, those of the company first), first_line, hits (map of scanner to count),
    report_length, ai_related, ai_confidence, ai_level, ai_score, ai_summary, org_relevance, sensitive."""
    m = lambda key, **v: message(key, lang, **v)
    p, cred = c("unified_probability"), c("credibility")
    person = lambda x: F.when(x["matches_company"], m("corporate_committer_target", name=x["name"], email=x["email"])).otherwise(m("corporate_committer_other", name=x["name"], email=x["email"], domain=x["domain"]))
    text, topics = F.coalesce(c("description"), F.lit("")), F.coalesce(c("topics"), F.lit(""))
    people, hits = c("committers"), c("hits")
    shown = F.array_join(F.slice(people, 1, PEOPLE), ", ")
    total = F.aggregate(F.map_values(hits), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    head = F.when(p >= 0.7, m("high_chance")).when(p >= 0.5, m("medium_chance")).when(p >= 0.2, m("low_chance")).otherwise(m("no_chance"))
    tail = [
        F.when(cred >= 0.7, m("repo_credibility_high", score=cred)).when(cred >= 0.4, m("repo_credibility_medium", score=cred)).otherwise(m("repo_credibility_low", score=cred)),
        F.when(c("is_tiny"), m("repo_is_tiny")),
        F.when(c("is_personal"), m("repo_is_personal")),
        F.when(c("is_very_popular"), m("repo_is_popular_oss")),
        m("leak_found_in_section", obj_type=c("obj_type"), dork=c("dork")),
        F.when(F.trim(text).isin(*NOTHING), m("no_description")).otherwise(m("short_description", description=cut(text, DESCRIPTION))),
        m("topics", topics=F.when(F.trim(topics).isin(*NOTHING), m("no_topics")).otherwise(topics)),
        F.when(F.size(people) > PEOPLE, m("committers_found", committers=shown, remaining=F.size(people) - PEOPLE)).otherwise(m("committers_all", committers=shown)),
        F.when(c("first_line").isNotNull(), m("first_grepscan_line", match=c("first_line"))),
        *(F.when(hits[s] > 0, m("leaks_found_by_scanner", count=hits[s], scanner=F.lit(s))) for s in SCANNERS),
        m("total_leaks_found", total_count=total),
        m("full_report_length", length=c("report_length")),
        F.when(c("ai_related"), m("ai_analysis_company_related", confidence=c("ai_confidence"))).when(~c("ai_related"), m("ai_analysis_company_unrelated", confidence=c("ai_confidence"))),
        F.when(c("ai_related").isNotNull() & c("ai_level").isin("high", "critical"), m("ai_analysis_high_severity", score=c("ai_score"))),
        F.when(c("ai_related").isNotNull() & (F.trim(c("ai_summary")) != ""), m("ai_analysis_summary", summary=cut(F.trim(c("ai_summary")), SUMMARY))),
        m("profitability_scores", org_rel=c("org_relevance"), sens_data=c("sensitive"), tp=p, fp=F.round(1 - p, 2)),
    ]
    lines = F.concat(F.array(head), F.transform(c("corporate"), person), F.array(*tail))
    return F.array_join(F.array_distinct(F.array_compact(lines)), "\n- ")


def with_reason(lines: Column, reason: Column, lang: str = "ru") -> Column:
    """Lines of a status with the reason of a closed case on the line of the description, or on a line of its own."""
    starts = [MESSAGES[x]["short_description"].partition("{")[0].strip() for x in ("en", "ru")]
    is_it = lambda x: reduce(lambda a, s: a | x.startswith(s), starts, F.lit(False))
    first = F.array_position(F.transform(lines, lambda x: is_it(x).cast("int")), 1)
    marked = F.transform(lines, lambda x, i: F.when(i + 1 == first, F.concat(x, F.lit(" | "), reason)).otherwise(x))
    own = F.array_append(lines, message("short_description", lang, description=F.concat(F.lit("- | "), reason)))
    return F.when(F.trim(F.coalesce(reason, F.lit(""))) == "", lines).when(first > 0, marked).otherwise(own)
