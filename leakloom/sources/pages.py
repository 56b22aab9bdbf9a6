"""Stored pages of a code host's REST and GraphQL interfaces as rows. Fetching them is another program's job: each line of a
capture is one JSON answer, and a page that is no JSON, or an answer of an error, gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page, pages that a search has at most.
PAGE, MOST = 100, 1000


def answers(spark: SparkSession, path: str) -> DataFrame:
    """page (VARIANT) and at (its place in the capture) of every answer."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("page"), F.monotonically_increasing_id().alias("at"))
    return rows.where(F.col("page").isNotNull())


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def items(pages: DataFrame, path: str) -> DataFrame:
    """node (VARIANT), at, nth of the list at ``path`` ('$' for the answer itself)."""
    listed = F.try_variant_get("page", path, "array<variant>")
    rows = pages.select("at", F.posexplode(listed).alias("nth", "node"))
    return rows.where(F.col("node").isNotNull() & ~F.is_variant_null("node"))


def page_count(total: Column) -> Column:
    """Pages to ask for; a search shows its first MOST results only."""
    return F.ceil(F.least(total, F.lit(MOST)) / PAGE).cast("int")


def stamp(t: Column) -> Column:
    """'2024-01-02T03:04:05Z' as a timestamp without zone; null for anything else."""
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.replace(F.left(t, F.lit(19)), F.lit("T"), F.lit(" ")))).cast("timestamp_ntz")


def pushed_between(as_of: Column, days: int) -> Column:
    """The part of a query that asks for repositories pushed to in the last days."""
    return F.concat(F.lit("pushed:"), F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd"), F.lit(".."), F.date_format(as_of, "yyyy-MM-dd"))


def names_at(v: Column, path: str, inner: str) -> Column:
    """The strings at ``inner`` of each element of a list; none if there is no list."""
    found = F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, inner, "string"))
    return F.filter(found, lambda x: x.isNotNull())


def repo_node(node: Column) -> Column:
    """struct of a GraphQL repository node, in the names that the REST interface has."""
    n = lambda p: F.coalesce(get(node, p, "int"), F.lit(0))
    b = lambda p: F.coalesce(get(node, p, "boolean"), F.lit(False))
    edges = F.coalesce(F.try_variant_get(node, "$.languages.edges", "array<variant>"), F.array().cast("array<variant>"))
    sized = F.transform(edges, lambda e: F.struct(F.try_variant_get(e, "$.node.name", "string").alias("k"), F.try_variant_get(e, "$.size", "long").alias("v")))
    return F.struct(
        get(node, "name").alias("name"),
        F.concat_ws("/", get(node, "owner.login"), get(node, "name")).alias("full_name"),
        get(node, "owner.login").alias("owner"),
        get(node, "url").alias("html_url"),
        b("isPrivate").alias("private"),
        *(get(node, f"{k}At").alias(f"{k}_at") for k in ("created", "updated", "pushed")),
        get(node, "description").alias("description"),
        *(n(p).alias(k) for k, p in (("stargazers_count", "stargazerCount"), ("forks_count", "forkCount"), ("watchers_count", "watchers.totalCount"), ("open_issues_count", "issues.totalCount"), ("size", "diskUsage"), ("collaborators_count", "collaborators.totalCount"), ("commit_count", "defaultBranchRef.target.history.totalCount"))),
        *(b(f"has{k}Enabled").alias(f"has_{k.lower()}") for k in ("Issues", "Projects", "Wiki")),
        F.lit(False).alias("has_downloads"),
        get(node, "primaryLanguage.name").alias("language"),
        names_at(node, "$.repositoryTopics.nodes", "$.topic.name").alias("topics"),
        F.map_from_entries(F.filter(sized, lambda e: e["k"].isNotNull())).alias("languages"),
    )


def code_node(node: Column) -> Column:
    """struct of a GraphQL code node; its repository as repo_node gives it."""
    path = F.coalesce(get(node, "path"), F.lit(""))
    text = F.nullif(F.coalesce(get(node, "text"), F.lit("")), F.lit(""))
    return F.struct(
        F.element_at(F.split(path, "/"), -1).alias("name"),
        get(node, "path").alias("path"),
        F.concat(get(node, "repository.url"), F.lit("/blob/master/"), get(node, "path")).alias("html_url"),
        repo_node(F.try_variant_get(node, "$.repository", "variant")).alias("repository"),
        F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>")).alias("fragments"),
    )


def _of_search(rows: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` nodes of a search, its pages in order; None: all of many searches, in no order."""
    return rows if most is None else rows.orderBy("at", "nth").limit(most)


def graphql_repos(pages: DataFrame, most: int | None = MOST) -> DataFrame:
    """Repositories of a search's pages in order, ``most`` at most (None: all of any number of pages); nodes without an owner are none."""
    rows = items(pages, "$.data.search.nodes").where(get(F.col("node"), "owner.login").isNotNull() & get(F.col("node"), "name").isNotNull())
    return _of_search(rows, most).select(repo_node(F.col("node")).alias("r")).select("r.*")


def graphql_code(pages: DataFrame, most: int | None = MOST) -> DataFrame:
    """Files of a search's pages in order, ``most`` at most (None: all of any number of pages); nodes without a repository are none."""
    rows = items(pages, "$.data.search.nodes").where(get(F.col("node"), "repository.owner.login").isNotNull())
    return _of_search(rows, most).select(code_node(F.col("node")).alias("r")).select("r.*")


def rest_items(pages: DataFrame) -> DataFrame:
    """node of REST search answers, in order of at and nth; an answer with a message is an error."""
    return items(pages.where(get(F.col("page"), "message").isNull()), "$.items")


def rest_repos(pages: DataFrame) -> DataFrame:
    """url and name of REST repository results."""
    n = F.col("node")
    return rest_items(pages).select(get(n, "html_url").alias("url"), get(n, "full_name").alias("full_name"), get(n, "owner.login").alias("author_name"), F.coalesce(get(n, "size", "int"), F.lit(0)).alias("size"))


def rest_code(pages: DataFrame) -> DataFrame:
    n = F.col("node")
    return rest_items(pages).select(get(n, "repository.html_url").alias("url"), get(n, "repository.full_name").alias("full_name"), get(n, "repository.owner.login").alias("author_name"), get(n, "path").alias("path"))


def rest_commits(pages: DataFrame) -> DataFrame:
    n = F.col("node")
    return rest_items(pages).select(get(n, "repository.html_url").alias("url"), get(n, "repository.full_name").alias("full_name"), get(n, "commit.author.name").alias("author_name"), get(n, "commit.author.email").alias("author_email"), get(n, "commit.message").alias("message"), get(n, "commit.author.date").alias("date"), get(n, "sha").alias("sha"))


def gists(pages: DataFrame, query: str = "") -> DataFrame:
    """Public gists whose description or a file's name has the query, whatever the case."""
    n = F.col("node")
    files = F.coalesce(F.map_keys(F.try_variant_get(n, "$.files", "map<string, variant>")), F.array().cast("array<string>"))
    rows = items(pages, "$").select(get(n, "html_url").alias("url"), F.coalesce(get(n, "description"), F.lit("")).alias("description"), files.alias("files"))
    has = lambda t: F.contains(F.lower(t), F.lit(query.lower()))
    return rows.where(has(F.col("description")) | F.exists("files", has)) if query else rows


def with_fallback(first: DataFrame, second: DataFrame, query: str = "query") -> DataFrame:
    """Results of the first interface; of the second for queries that the first has none for."""
    return first.unionByName(second.join(first.select(query).distinct(), query, "left_anti"), allowMissingColumns=True)


def full_stats(pages: DataFrame) -> DataFrame:
    """One row for each answer about one repository: found (false: deleted or private), its numbers, contributors, and distinct
    commit authors by address, the first name of each."""
    p = F.col("page")
    repo = F.try_variant_get(p, "$.data.repository", "variant")
    there = ~F.is_variant_null(F.coalesce(repo, F.parse_json(F.lit("null"))))
    commits = F.coalesce(F.try_variant_get(p, "$.data.repository.defaultBranchRef.target.history.nodes", "array<variant>"), F.array().cast("array<variant>"))
    people = F.transform(commits, lambda x, i: F.struct(F.try_variant_get(x, "$.author.email", "string").alias("email"), i.alias("i"), F.coalesce(F.try_variant_get(x, "$.author.name", "string"), F.lit("")).alias("name"), F.try_variant_get(x, "$.author.user.login", "string").alias("login")))
    # sorted by address and place, as a column of its own: in a lambda an expression is computed anew for each element
    by_mail = F.array_sort(F.filter(people, lambda x: F.coalesce(x["email"], F.lit("")) != ""))
    firsts = F.filter("__by_mail", lambda x, i: (i == 0) | (F.get("__by_mail", i - 1)["email"] != x["email"]))
    once = F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), F.struct(x["email"].alias("email"), x["name"].alias("name"), x["login"].alias("login")).alias("a")))), lambda x: x["a"])
    n = lambda path: F.coalesce(get(p, "data.repository." + path, "int"), F.lit(0))
    rows = pages.where(F.try_variant_get(p, "$.data", "variant").isNotNull() & ~F.is_variant_null(F.coalesce(F.try_variant_get(p, "$.data", "variant"), F.parse_json(F.lit("null")))))
    return rows.withColumn("__by_mail", by_mail).select(
        "at",
        there.alias("found"),
        *(stamp(get(p, f"data.repository.{k}At")).alias(f"{k}_at") for k in ("created", "updated", "pushed")),
        F.coalesce(get(p, "data.repository.description"), F.lit("")).alias("description"),
        *(n(path).alias(k) for k, path in (("size", "diskUsage"), ("stargazers_count", "stargazerCount"), ("forks_count", "forkCount"), ("watchers_count", "watchers.totalCount"), ("open_issues_count", "issues.totalCount"), ("contributors_count", "mentionableUsers.totalCount"), ("commits_count", "defaultBranchRef.target.history.totalCount"))),
        names_at(p, "$.data.repository.repositoryTopics.nodes", "$.topic.name").alias("topics"),
        names_at(p, "$.data.repository.mentionableUsers.nodes", "$.login").alias("contributors"),
        once.alias("commit_authors"),
    )


def stats_row(found: DataFrame) -> DataFrame:
    """repo_node's columns as a row of leak_stats: flags as 0 and 1, topics joined, defaults where nothing is known."""
    c = F.col
    text = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("_"))
    flags = [F.coalesce(c(f"has_{k}").cast("int"), F.lit(0)).alias(f"has_{k}") for k in ("issues", "projects", "downloads", "wiki")]
    counts = {"size": "size", "stargazers_count": "stargazers_count", "forks_count": "forks_count", "open_issues_count": "open_issues_count", "subscribers_count": "watchers_count", "contributors_count": "collaborators_count", "commits_count": "commit_count"}
    return found.select("full_name", *(c(v).alias(k) for k, v in counts.items()), *flags, F.lit(0).alias("has_pages"), F.lit(0).alias("commiters_count"), F.lit(-1).alias("ai_result"), text(F.array_join("topics", ",")).alias("topics"), text(c("description")).alias("description"), stamp(c("created_at")).alias("created_at"), stamp(c("updated_at")).alias("updated_at"))


def rest_stats(pages: DataFrame) -> DataFrame:
    """Answers about one repository or gist as rows of leak_stats with reason, why it can't be read (null: it can).

    A gist's size is that of its files; an empty repository, and answers 404, 403 and 409 of an empty one, can't be read."""
    p = F.col("page")
    n = lambda path: F.coalesce(get(p, path, "int"), F.lit(0))
    files = F.try_variant_get(p, "$.files", "map<string, variant>")
    size = F.when(files.isNotNull(), F.aggregate(F.map_values(files), F.lit(0), lambda a, f: a + F.coalesce(F.try_variant_get(f, "$.size", "int"), F.lit(0)))).otherwise(n("size"))
    forks = F.coalesce(F.size(F.try_variant_get(p, "$.forks", "array<variant>")), get(p, "forks", "int"), F.lit(0))
    status, message = F.coalesce(get(p, "status"), F.lit("")), F.lower(F.coalesce(get(p, "message"), F.lit("")))
    refused = F.when((status == "409") & message.contains("empty"), "empty").when(status == "404", "not found").when(status == "403", "forbidden")
    flag = lambda k: F.when(files.isNotNull(), F.lit(0)).otherwise(F.coalesce(get(p, f"has_{k}", "boolean"), F.lit(False)).cast("int"))
    rows = pages.select(
        "at",
        F.coalesce(get(p, "full_name"), get(p, "html_url")).alias("name"),
        size.alias("size"),
        n("stargazers_count").alias("stargazers_count"),
        F.when(files.isNotNull(), forks).otherwise(n("forks_count")).alias("forks_count"),
        n("open_issues_count").alias("open_issues_count"),
        n("subscribers_count").alias("subscribers_count"),
        *(flag(k).alias(f"has_{k}") for k in ("issues", "projects", "downloads", "wiki", "pages")),
        F.coalesce(F.nullif(F.array_join(F.coalesce(F.try_variant_get(p, "$.topics", "array<string>"), F.array().cast("array<string>")), "_"), F.lit("")), F.lit("_")).alias("topics"),
        F.coalesce(F.nullif(get(p, "description"), F.lit("")), F.lit("_")).alias("description"),
        stamp(get(p, "created_at")).alias("created_at"),
        stamp(get(p, "updated_at")).alias("updated_at"),
        refused.alias("reason"),
    )
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("size") == 0, "size 0")))


def readable(stats: DataFrame) -> DataFrame:
    """Repositories whose contributors and commits are worth asking for."""
    return stats.where("reason is null")


def contributors(pages: DataFrame) -> DataFrame:
    """at, account, contributions of answers that list contributors; a login once for each answer."""
    n = F.col("node")
    rows = items(pages, "$").select("at", "nth", get(n, "login").alias("account"), F.coalesce(get(n, "contributions", "int"), F.lit(0)).alias("contributions")).where("account is not null")
    return rows.groupBy("at", "account").agg(F.min_by("contributions", "nth").alias("contributions"))


def commits(pages: DataFrame) -> DataFrame:
    """repo (the answer's place), seq, name, email of answers that list commits, for operators.tables.committers_first_seen."""
    n = F.col("node")
    return items(pages, "$").select(F.col("at").alias("repo"), F.col("nth").alias("seq"), F.coalesce(get(n, "commit.author.name"), F.lit("")).alias("name"), F.coalesce(get(n, "commit.author.email"), F.lit("")).alias("email"))


def candidate(kind: str, url: Column, dork: Column, author: Column, company_id: Column) -> Column:
    """struct of one candidate: address of owner and name, on the host of gists for lists, and who wrote it."""
    rest = F.split(F.element_at(F.split(url, r"github\.com/"), -1), "/")
    name = F.concat_ws("/", F.get(rest, 0), F.get(rest, 1))
    host = "https://gist.github.com/" if kind == "Glist" else "https://github.com/"
    return F.struct(F.lit(kind).alias("obj_type"), F.concat(F.lit(host), name).alias("repo_url"), name.alias("repo_name"), F.coalesce(author, F.get(rest, 0)).alias("author_name"), dork.alias("dork"), company_id.alias("company_id"))

