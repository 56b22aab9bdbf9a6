"""Captures, lists, settings, stored pages, reports and quotas on small inputs of their own."""

import json

import pytest
from pyspark.sql import functions as F

from leakloom.functions import registry
from leakloom.operators import findings as N
from leakloom.operators import reports as R
from leakloom.operators import store as O
from leakloom.operators import tables as T
from leakloom.sources import captures as C
from leakloom.sources import lists as L
from leakloom.sources import pages as G
from leakloom.streaming import quota as Q


def test_objects_run_together(spark, tmp_path):
    whole = [{"Raw": "a}{b"}, {"Raw": 'q"}{"', "x": {"y": 1}}, {"RawV2": "\\", "Raw": "n"}]
    (tmp_path / "t.json").write_text("".join(json.dumps(x) for x in whole) + "\nnot json\n" + json.dumps({"Raw": "last"}) + "\n\n")
    assert sorted(r["match"] for r in C.trufflehog(spark, str(tmp_path / "t.json")).collect()) == sorted(["a}{b", 'q"}{"', "\\", "last"])


def test_first_head_of_a_capture(spark, tmp_path):
    long = "z" * 100
    (tmp_path / "p.json").write_text(json.dumps({"b": [{"line": long + "1"}, {"line": "two"}], "a": [{"line": long + "2"}, {"line": "two"}]}))
    assert sorted((r.file, r["match"]) for r in C.deepsecrets(spark, str(tmp_path / "p.json")).collect()) == [("b", "two"), ("b", long)]


def test_service_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("[ERROR] Matched one or more prohibited patterns\na.py:3: key=1\nb.py:ab\nb.py:abc\nbare line\nshort\nUsage: x\n\n")
    got = [(r.file, r.position, r["match"]) for r in C.git_secrets(spark, str(tmp_path / "s.txt")).collect()]
    assert sorted(got, key=str) == sorted([("a.py", "3", "key=1"), ("b.py", None, "abc"), (None, None, "bare line")], key=str)


def test_lists_and_settings(spark, tmp_path):
    (tmp_path / "l.txt").write_text("one  \n\n two\n")
    assert [r.term for r in L.lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", " two"]
    urls = spark.createDataFrame([("https://h.com/a+b",), ("https://h.com/c",), ("x1",), (None,)], "url string")
    patterns = L.with_exclusions(spark.createDataFrame([("x[0-9]",)], "term string"), urls.limit(1))
    assert [r.url for r in L.unexcluded(urls, patterns).collect()] == ["https://h.com/c", None]
    assert L.with_exclusions(patterns, urls.limit(1)).count() == 2
    (tmp_path / "c.json").write_text('{"A": "1", "B": "2", "C": "3"}')
    (tmp_path / ".env").write_text("# no\nexport B='two'\nD = 4\n")
    assert L.settings(str(tmp_path / "c.json"), str(tmp_path / ".env"), {"C": "c", "Z": "z"}) == {"A": "1", "B": "two", "C": "c", "D": "4"}
    assert L.settings(str(tmp_path / "none"), None, {}) == {}


def test_pages_of_errors(spark, tmp_path):
    (tmp_path / "p").write_text("broken\n" + json.dumps({"message": "rate limit", "items": [{"html_url": "u"}]}) + "\n" + json.dumps({"items": [{"html_url": "v", "full_name": "o/r", "owner": {"login": "o"}}, None]}) + "\n")
    pages = G.answers(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in G.rest_repos(pages).collect()] == [("v", "o/r", "o", 0)]
    assert G.graphql_repos(pages).collect() == [] and G.gists(pages, "x").collect() == []
    gone = G.full_stats(spark.createDataFrame([(1, '{"data": {"repository": null}}'), (2, '{"data": null}')], "at long, j string").select("at", F.parse_json("j").alias("page"))).collect()
    assert [(r["at"], r.found, r.commit_authors) for r in gone] == [(1, False, [])]


def test_commits_and_rest_kinds(spark):
    j = json.dumps({"items": [{"sha": "s", "repository": {"html_url": "u", "full_name": "o/r", "owner": {"login": "o"}}, "path": "a/b.py", "commit": {"message": "m", "author": {"name": "n", "email": "e", "date": "d"}}}]})
    pages = spark.createDataFrame([(0, j)], "at long, j string").select("at", F.parse_json("j").alias("page"))
    assert tuple(G.rest_commits(pages).first()) == ("u", "o/r", "n", "e", "m", "d", "s")
    assert tuple(G.rest_code(pages).first()) == ("u", "o/r", "o", "a/b.py")
    assert [G.page_count(F.lit(n)) is not None for n in (0, 1)] == [True, True]
    assert [r.n for r in spark.range(4).select(G.page_count(F.array(*map(F.lit, (0, 100, 101, 5000)))[F.col("id").cast("int")]).alias("n")).collect()] == [0, 1, 2, 10]


def test_normalised_caps_before_it_compares(spark):
    rows = [("r", "s", i, "same" if i < 3 else f"m{i}", None) for i in range(6)] + [("r", "t", 0, "x" * 150, "f")]
    got = N.normalised(spark.createDataFrame(rows, "repo string, scanner string, seq int, match string, file string"), cap=4).collect()
    assert sorted((r.scanner, r.leak_no, r["match"]) for r in got) == [("s", 0, "same"), ("s", 1, "m3"), ("t", 0, "x" * 100 + "...")]


def test_loads_repeat_without_change(spark):
    accounts = spark.createDataFrame([(1, "a", 0, 0)], "id long, account string, need_monitor int, related_company_id int")
    people = spark.createDataFrame([("a", 1, "7", 5), ("b", 1, "x", 5), ("b", 0, "3", 6)], "account string, need_monitor int, company_id string, leak_id long")
    once = O.with_accounts(accounts, people)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0, 0), (2, "b", 1, 0)]
    assert sorted(map(tuple, O.with_accounts(once, people).collect())) == sorted(map(tuple, once.collect()))
    links = O.with_links(spark.createDataFrame([], "leak_id long, account_id long"), once, people)
    assert sorted(map(tuple, O.with_links(links, once, people).collect())) == [(5, 1), (5, 2), (6, 2)]


def test_lifecycle_moves(spark):
    leaks = spark.createDataFrame([("a", 4), ("b", 1), ("c", 5), ("d", 0), ("e", 4)], "url string, result int")
    events = spark.createDataFrame([("a", 2, "gone"), ("a", 1, "judged:5"), ("b", 1, "judged:0"), ("b", 2, "gone"), ("c", 1, "judged:7"), ("d", 1, "judged:4")], "url string, seq int, kind string")
    assert {r.url: r.result for r in O.lifecycle(leaks, events).collect()} == {"a": 2, "b": 3, "c": 5, "d": 0, "e": 4}


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = [("t", "core", i, 5000, 100 - i if i % 2 else None, None) for i in range(6)] + [("u", "core", 1, 60, 7, None)]
    df = spark.createDataFrame(rows, "token string, resource string, at long, limit long, remaining long, reset long")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = Q.quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("quota_now").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("quota_now").collect())) == sorted((r.token, r.resource, r["limit"], r.remaining, r.reset) for r in Q.quotas(df).collect())


def test_page_escapes(spark):
    text = R.page("<t>", {"a&b": spark.createDataFrame([("<script>", None)], "x string, y string")})
    assert "&lt;script&gt;" in text and "<script>" not in text and "a&amp;b" in text


def test_registry(spark):
    df = spark.createDataFrame([("a@b.c",)], "e string")
    assert registry.apply(df, "email_domain", "d", "e").first().d == "b.c"
    with pytest.raises(ValueError):
        registry.register("email_domain", lambda c: c)
    registry.register("own_test", F.upper)
    assert registry.apply(df, "own_test", "u", "e").first().u == "A@B.C"


def test_first_seen_breaks_ties_by_row(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "b"), ("k", 0, "c"), (None, 3, "d")], "k string, o int, v string")
    assert sorted(map(tuple, T.first_seen(df, ["k"], ["o"]).collect()), key=str) == sorted([("k", 0, "c"), (None, 3, "d")], key=str)


def test_command_line(spark, tmp_path, capsys):
    from leakloom import cli
    from leakloom.plans import views as V

    V.incidents(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "leaks"))
    assert cli.main(["status", str(tmp_path / "leaks")]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 6
    assert cli.main(["report", str(tmp_path / "leaks"), "--out", str(tmp_path / "r.html")]) == 0 and "<h2>Platforms" in (tmp_path / "r.html").read_text()
    assert cli.main(["recheck", str(tmp_path / "leaks"), "--most", "3"]) == 0
    assert all("github.com" in x for x in capsys.readouterr().out.strip().splitlines())
    (tmp_path / "s.txt").write_text("a.py:1:verysecretvalue\n")
    assert cli.main(["scan", "o/r", f"gitsecrets={tmp_path}/s.txt", "--out", str(tmp_path / "out")]) == 0
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.repo, r["match"], r.leak_no) for r in got] == [("o/r", "very*******alue", 0)]


def test_status_text(spark):
    from leakloom.operators import narrative as S

    row = {"unified_probability": 0.55, "credibility": 0.4, "is_tiny": True, "is_personal": False, "is_very_popular": None, "obj_type": "Code", "dork": "zeta", "description": "d" * 60, "topics": "_", "committers": [f"n{i}/m{i}" for i in range(7)], "corporate": [("z", "z@zeta.q", "zeta.q", True), ("y", "y@y.q", "y.q", False)], "first_line": None, "hits": {"gitleaks": 2, "grepscan": 1}, "report_length": 9, "ai_related": False, "ai_confidence": 0.5, "ai_level": "high", "ai_score": 0.75, "ai_summary": " ", "org_relevance": 0.1, "sensitive": 0.25}
    schema = "unified_probability double, credibility double, is_tiny boolean, is_personal boolean, is_very_popular boolean, obj_type string, dork string, description string, topics string, committers array<string>, corporate array<struct<name string, email string, domain string, matches_company boolean>>, first_line string, hits map<string, long>, report_length long, ai_related boolean, ai_confidence double, ai_level string, ai_score double, ai_summary string, org_relevance double, sensitive double"
    df = spark.createDataFrame([tuple(row.values())], schema.replace("name string", "name: string").replace("email string", "email: string").replace("domain string", "domain: string").replace("matches_company boolean", "matches_company: boolean"))
    lines = df.select(S.status(F.col, "en").alias("s")).first().s.split("\n- ")
    assert lines[0] == "Medium chance of leak" and "TARGET COMPANY email: z <z@zeta.q>" in lines[1] and "(domain: y.q)" in lines[2]
    assert "Brief description: " + "d" * 50 + "..." in lines and "Topics: Topics: none" in lines
    assert "Found the following committers: n0/m0, n1/m1, n2/m2, n3/m3, n4/m4. There are 2 more committers" in lines
    assert lines.index("Found 1 leaks by grepscan scanner") < lines.index("Found 2 leaks by gitleaks scanner") < lines.index("Total leaks found: 3")
    assert lines[-1].endswith("Org Relevance: 0.10, Sensitive Data: 0.25, True Positive: 0.55, False Positive: 0.45") and len(lines) == len(set(lines))
    closed = df.select(S.with_reason(F.array(F.lit("a"), F.lit("Brief description: x")), F.lit("why"), "en").alias("r"), S.with_reason(F.array(F.lit("a")), F.lit("why"), "en").alias("s"), S.with_reason(F.array(F.lit("a")), F.lit(" "), "en").alias("t")).first()
    assert closed.r == ["a", "Brief description: x | why"] and closed.s == ["a", "Brief description: - | why"] and closed.t == ["a"]


def test_jobs(spark):
    from leakloom import jobs

    urls = spark.createDataFrame([("https://github.com/a/b",), ("https://github.com/a/b/c",), ("https://github.com/k/n",), ("https://github.com/x/y",), ("https://github.com/p/q",), ("no",)], "url string")
    one = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    out = jobs.listed(urls, one("https://github.com/k/n/tree"), one("https://github.com/p/q"), spark.createDataFrame([("https://github\\.com/x/.*",)], "term string"))
    assert [tuple(r) for r in out.collect()] == [("https://github.com/a/b", "https://github.com/a/b")]
    leaks = spark.createDataFrame([(i, f"https://github.com/o/r{i % 8}", 5 if i >= 8 else 4) for i in range(12)] + [(50, "https://gitlab.com/o/r", 5)], "id long, url string, result int")
    plan = {k: sorted((r.id, r.batch) for r in d.collect()) for k, d in jobs.schedule(leaks)}
    assert plan == {"deep": [(8, "0-0"), (9, "0-0"), (10, "0-0"), (11, "0-0")], "again": [(4, "0-0"), (5, "0-0"), (6, "0-0"), (7, "0-0")]}
    t = jobs.in_turn(["a", "b"])
    assert [next(t) for _ in range(5)] == ["a", "b", "a", "b", "a"]
    waits, left = [], [OSError(), ConnectionError()]

    def step():
        if left:
            raise left.pop()
        return "done"

    assert jobs.retried(step, 3, waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        jobs.retried(lambda: open("/none/of/these"), 2, waits.append)
    c = spark.createDataFrame([("r", True), ("s", None)], "repo string, ai_related boolean")
    a = spark.createDataFrame([("r", False, 0.5, 0.1, 0.2)], "repo string, ai_related boolean, ai_confidence double, ai_tp double, ai_severity double")
    assert sorted((r.repo, r.ai_result) for r in jobs.with_answers(c, a).collect()) == [("r", 0), ("s", -1)]


def test_log_lines():
    import logging
    import sys

    from leakloom.log import JsonLines

    try:
        raise KeyError("q")
    except KeyError:
        r = logging.LogRecord("z", logging.WARNING, "f.py", 3, "a %s é", ("b",), sys.exc_info(), "g")
    r.repo = "o/r"
    out = json.loads(JsonLines().format(r))
    assert (out["level"], out["message"], out["repo"], out["line"]) == ("WARNING", "a b é", "o/r", 3) and "KeyError" in out["exception"]
