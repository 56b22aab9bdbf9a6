"""The incident store: eight tables, requests to them, and loads that give the same rows when they are run again.

Tables are DataFrames; each function returns new ones, which the caller writes. New rows get ids after the largest there is,
in the order of their natural key, so a repeated load finds its rows already there and adds none."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakloom.functions import documents as J
from leakloom.functions import rules as R
from leakloom.operators import tables as D
from leakloom.operators.ranking import numbered

#: Other names of tables and of their columns in requests; statuses that a load doesn't touch any more.
ALIASES = {"company": "companies", "dork": "dorks", "account": "account"}
FIELDS = {"accounts": {"company_id": "related_company_id"}}
DONE = (1, 2, 3)


def request(store: Mapping[str, DataFrame], tname: str, filters: dict | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a table by equality filters; companies also show their name as ``name``."""
    table = ALIASES.get(tname, tname)
    page = D.scan(store[table], {FIELDS.get(table, {}).get(k, k): v for k, v in (filters or {}).items()}, limit, offset)
    return page.withColumn("name", F.col("company_name")) if table == "companies" else page


def mapped(tname: str, rows: DataFrame) -> DataFrame:
    """Rows with the column names that the table has."""
    return rows.withColumnsRenamed(FIELDS.get(tname, {}))


def with_ids(rows: DataFrame, table: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """rows with ids after the table's largest, in order of the first three digits of their key's MD5, then of the key.

    Each of the 4,096 heads is numbered on its own; one row a head carries the count before it, so no task sorts all rows."""
    top = table.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("__c")).select(F.lit("").alias("__h"), "__c")
    headed = rows.withColumn("__h", F.left(F.md5(F.col(key).cast("string")), F.lit(3)))
    sizes = headed.groupBy("__h").agg(F.count("*").alias("__c")).unionByName(top)  # 4,097 rows at most
    before = sizes.select("__h", (F.sum("__c").over(W.orderBy("__h")) - F.col("__c")).alias("__b"))
    own = F.row_number().over(W.partitionBy("__h").orderBy(key))
    out = headed.withColumn("__i", own).join(before, "__h")
    return out.withColumn(id_, F.col("__b") + F.col("__i")).drop("__h", "__i", "__b")


def inserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows whose key it lacks, the first of each key (seq), with new ids."""
    names = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg((F.min_by(F.struct(*names), "seq") if "seq" in names else F.first(F.struct(*names))).alias("r")).select(key, "r.*")
    new = with_ids(D.unseen(first, table, key), table, key)
    return table.unionByName(new.select(*table.columns) if set(table.columns) <= set(new.columns) else new.drop("seq"), allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the non-key columns of ``changes`` in its rows of the same key; null changes too, other keys do nothing."""
    names = [c for c in changes.columns if c != key]
    both = table.join(changes.select(key, F.struct(*names).alias("__c")), key, "left")
    return both.select(*(F.when(F.col("__c").isNotNull(), F.col(f"__c.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def needs_analysis(result: Column, should_close: Column, error: Column, url: Column, size: Column) -> Column:
    """False for what is clearly no leak: judged so, too large or unreadable, or a gist or empty repository that can't be cloned."""
    low = F.lower(F.coalesce(error, F.lit("")))
    blocked = low.rlike("oversize|not analyze") | (low.contains("clone") & (F.contains(url, F.lit("gist.github.com")) | (F.coalesce(size, F.lit(0)) == 0)))
    return (F.coalesce(result, F.lit(4)) != 0) & ~F.coalesce(should_close, F.lit(False)) & ~blocked


def split_load(batch: DataFrame, leaks: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows to update) of a batch: new urls once each (the first by seq), except those of leak_type 'None'; known
    ones with the id of their leak, unless that is done with."""
    known = leaks.groupBy(key).agg(F.min_by(F.struct("id", "result"), "id").alias("__old"))
    both = batch.join(known, key, "left")
    add = D.first_seen(both.where(F.col("__old").isNull() & ~F.coalesce(F.col("leak_type") == "None", F.lit(False))).drop("__old"), [key], ["seq"])
    old = both.where(F.col("__old").isNotNull() & ~F.coalesce(F.col("__old.result"), F.lit(4)).cast("int").isin(*DONE))
    return add, old.withColumn("id", F.col("__old.id")).drop("__old")


def staged(leaks: DataFrame, accounts: DataFrame, links: DataFrame, new: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """leak, raw_report, leak_stats, accounts and related_accounts_leaks after a load of new(url, ..., raw_data, ai_report, stats
    struct) and people(url, account, need_monitor, company_id). A url that is already there keeps its id and gets the linked rows."""
    leak = inserted(leaks, new.select(*(c for c in leaks.columns if c != "id"), "seq"), "url")
    ids = leak.groupBy("url").agg(F.min("id").alias("leak_id"))
    owned = new.join(ids, "url")
    report = owned.select("leak_id", F.col("url").alias("report_name"), "raw_data", "ai_report")
    stats = D.stats_coerced(owned.select("leak_id", "stats.*"), [c for c in new.schema["stats"].dataType.names if not c.startswith("has_") and c != "description"], [c for c in new.schema["stats"].dataType.names if c.startswith("has_")])
    account = with_accounts(accounts, people)
    return {"leak": leak, "raw_report": report, "leak_stats": stats, "accounts": account, "related_accounts_leaks": with_links(links, account, people.join(ids, "url"))}


def with_accounts(accounts: DataFrame, people: DataFrame) -> DataFrame:
    """accounts(id, account, need_monitor, related_company_id) with those of people it lacks, by name."""
    company = F.coalesce(F.col("company_id").cast("string").try_cast("int"), F.lit(0))
    rows = people.groupBy("account").agg(F.max("need_monitor").alias("need_monitor"), F.min(company).alias("related_company_id"))
    return inserted(accounts, rows, "account")


def with_links(links: DataFrame, accounts: DataFrame, people: DataFrame) -> DataFrame:
    """links(leak_id, account_id) with those of people(leak_id, account) it lacks."""
    wanted = people.select("leak_id", "account").join(accounts.groupBy("account").agg(F.min("id").alias("account_id")), "account").select("leak_id", "account_id").distinct()
    return links.select("leak_id", "account_id").unionByName(wanted.join(links, ["leak_id", "account_id"], "left_anti"))


def with_companies(companies: DataFrame, dorks: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, dorks, name to id) after a load of targets(company_name, terms array); terms are stored for new companies only."""
    out = inserted(companies, targets.select("company_name"), "company_name")
    ids = out.groupBy("company_name").agg(F.min("id").alias("company_id"))
    new = D.unseen(targets, companies, "company_name").join(ids, "company_name")
    coded = new.select(F.base64(F.encode(F.array_join("terms", ", "), "UTF-8")).alias("dork"), "company_id")
    return out, dorks.unionByName(coded, allowMissingColumns=True), targets.select("company_name").join(ids, "company_name", "left").select("company_name", F.coalesce("company_id", F.lit(1)).alias("company_id"))


#: Names of companies that older stores have no row for.
COMPANIES = {1: "vtb", 2: "inno", 3: "t1"}


def company_name(stored: Column, company_id: Column) -> Column:
    """The stored name, else the known one of an old id, else one made of the id; an id that is no number is a name itself."""
    number = company_id.cast("string").try_cast("long")
    known = F.create_map(*(x for k, v in COMPANIES.items() for x in (F.lit(k).cast("long"), F.lit(v))))
    return F.when(number.isNull(), company_id.cast("string")).otherwise(F.coalesce(stored, known[number], F.concat(F.lit("company_"), number.cast("string"))))


def current_terms(dorks: DataFrame) -> DataFrame:
    """company_id, term: the last stored list of each company, decoded."""
    last = dorks.groupBy("company_id").agg(F.max_by("dork", "id").alias("dork"))
    return last.select("company_id", F.explode(F.split(F.decode(F.unbase64("dork"), "UTF-8"), ", ")).alias("term"))


def merged_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two reports' findings (repo, scanner, leak, field, value) in one: a new value replaces the old one of its place, but for
    empty ones; scanners that aren't known keep what they had."""
    keys = ["repo", "scanner", "leak", "field"]
    usable = new.where(F.col("scanner").isin(R.SCANNERS) & (F.coalesce("value", F.lit("")) != ""))
    both = old.select(*keys, "value", F.lit(0).alias("__r")).unionByName(usable.select(*keys, "value", F.lit(1).alias("__r")))
    return both.groupBy(*keys).agg(F.max_by("value", "__r").alias("value"))


def merged_notes(old: Column, new: Column) -> Column:
    """A message or a model's report: the new one, unless empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def refreshed(leaks: DataFrame, load: DataFrame) -> DataFrame:
    """Known leaks after load(id, level, author_info, leak_type, result, updated_at, payload): a row whose updated_at and payload are
    the stored ones, and a leak that is done with, stay as they are."""
    names = ["level", "author_info", "leak_type", "result", "updated_at", "payload"]
    both = leaks.join(load.select("id", F.struct(*names).alias("__n")), "id", "left")
    same = F.col("__n.updated_at").eqNullSafe(F.col("updated_at")) & F.col("__n.payload").eqNullSafe(F.col("payload"))
    change = F.col("__n").isNotNull() & ~same & ~F.coalesce(F.col("result"), F.lit(4)).cast("int").isin(*DONE)
    return both.select(*(F.when(change, F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in leaks.columns))


def contributor_counts(stats: DataFrame, stored: DataFrame, new: DataFrame) -> DataFrame:
    """leak_id, contributors_count: the larger of the stored count and the accounts known or new (both leak_id, account)."""
    people = stored.select("leak_id", "account").unionByName(new.select("leak_id", "account")).groupBy("leak_id").agg(F.countDistinct("account").alias("n"))
    return stats.join(people, "leak_id", "left").select("leak_id", F.greatest(F.coalesce("contributors_count", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0))).alias("contributors_count"))


#: States of a leak, and events of one address that are composed in one group.
STATES, SPAN = 6, 1024


def _moved(state: Column, kind: Column) -> Column:
    """The state after an event of that kind."""
    to = F.regexp_extract(kind, "^judged:([045])$", 1)
    return F.when((to != "") & state.isin(4, 5), to.try_cast("int")).when((kind == "gone") & (state == 1), 3).when((kind == "gone") & (state == 5), 2).otherwise(state)


def lifecycle(leaks: DataFrame, events: DataFrame, span: int = SPAN) -> DataFrame:
    """leaks(url, result) after events(url, seq, kind): 'judged:0', 'judged:4' or 'judged:5' move an open one (4, 5) to its verdict, 'gone'
    moves 1 to 3 and 5 to 2; other moves aren't allowed and change nothing. Events count in order of seq, then kind; a null
    state, and one that no leak can have, stays as it is.

    An event takes each of the six states to a state, and such maps compose: events are numbered, ``span`` neighbours make one
    map, and so do ``span`` of these, until an address has one. A group never holds more than ``span`` of them."""
    told = events.where(F.col("kind").rlike("^judged:[045]$") | (F.col("kind") == "gone")).select("url", "seq", "kind")
    at = numbered(told, ["url"], ["seq", "kind"], "at")
    same = F.array(*(F.lit(s) for s in range(STATES)))
    maps = at.groupBy("url", (F.floor(F.col("at") / span)).cast("int").alias("at_")).agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("es"))
    maps = maps.select("url", F.col("at_").alias("at"), F.aggregate("es", same, lambda m, e: F.transform(m, lambda s: _moved(s, e["kind"]))).alias("m"))
    groups = told.groupBy("url").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while (groups := -(-groups // span)) > 1:
        level = maps.groupBy("url", (F.floor(F.col("at") / span)).cast("int").alias("at_")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
        maps = level.select("url", F.col("at_").alias("at"), F.aggregate("ms", same, lambda m, e: F.transform(m, lambda s: F.get(e["m"], s))).alias("m"))
    end = F.when(F.col("result").between(0, STATES - 1), F.get("m", F.col("result").cast("int")))
    return leaks.join(maps.select("url", "m"), "url", "left").withColumn("result", F.coalesce(end, F.col("result").cast("int"))).select(*leaks.columns)


def with_reports(leaks: DataFrame, reports: DataFrame) -> DataFrame:
    """raw_report rows of these leaks, decoded."""
    rows = reports.join(leaks.select(F.col("id").alias("leak_id")).distinct(), "leak_id", "left_semi")
    return rows.withColumn("raw", J.decoded_blob(F.col("raw_data"))).withColumn("ai", J.decoded_blob(F.col("ai_report")))


def write_json(df: DataFrame, path: str) -> None:
    """A result file of JSON lines, one for each row."""
    df.write.mode("overwrite").json(path)


def checked_once(repos: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """Repositories in the order they were met, each once."""
    return D.first_seen(repos, [key], [order])


#: Kilobytes of a repository that is cloned at most.
MOST_KB = 300_000


def with_status(leaks: DataFrame, *codes: int) -> DataFrame:
    return leaks.where(F.col("result").isin(*codes))


def id_of(leaks: DataFrame, url: str) -> DataFrame:
    """The id of the first incident of an address; no row if there is none."""
    return leaks.where(F.col("url") == url).orderBy("id").limit(1).select("id")


def ids_of(urls: DataFrame, leaks: DataFrame) -> DataFrame:
    """url, id (null: none) of each address, for many at once."""
    return urls.select("url").distinct().join(leaks.groupBy("url").agg(F.min("id").alias("id")), "url", "left")


def of_leaks(rows: DataFrame, leaks: DataFrame, key: str = "leak_id") -> DataFrame:
    """Rows of a table that belong to these incidents."""
    return rows.join(leaks.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(*rows.columns)


def company_of(rows: DataFrame, leaks: DataFrame, key: str = "leak_id") -> DataFrame:
    """Rows with the company of their incident, 1 where it has none."""
    return rows.join(leaks.select(F.col("id").alias(key), F.col("company_id").alias("__c")), key, "left").withColumn("company_id", F.coalesce("__c", F.lit(1))).drop("__c")


def account_names(links: DataFrame, accounts: DataFrame) -> DataFrame:
    """leak_id, names: the accounts linked to each incident, sorted."""
    named = links.join(accounts.select(F.col("id").alias("account_id"), "account"), "account_id")
    return named.groupBy("leak_id").agg(F.array_sort(F.collect_set("account")).alias("names"))


def lines_of(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings(file, line_no, ...) with the text of their line, null where there is none."""
    return findings.join(lines.select("file", "line_no", "text"), ["file", "line_no"], "left")


def small_enough(repos: DataFrame, most: int = MOST_KB) -> DataFrame:
    return repos.where(F.col("size") <= most)
