"""Store operators, captures, streams, and every registered query against its oracle at the smallest scale."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from leakloom.operators import tables as T
from leakloom.operators.people import committers_first_seen
from leakloom.plans.registry import ORACLE_SQL, QUERIES
from leakloom.sources import captures as C
from leakloom.streaming import ingest as I

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 8)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        at = [c[0] for c in r.description]
        assert sorted(at) == cols
        assert got == sorted((tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall()), key=str)


def test_committers_first_seen(spark):
    rows = [("r", "a", "x", 1), ("r", "a", "y", 2), ("r", "b", "x", 3), ("r", "b", "y", 4), ("s", "a", "x", 5)]
    df = spark.createDataFrame(rows, "repo string, name string, email string, seq long")
    assert sorted(r.seq for r in committers_first_seen(df).collect()) == [1, 4, 5]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = T.upsert(old, new, "id", ["v"])
    assert sorted(map(tuple, T.upsert(once, new, "id", ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_captures(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"StartLine":1,"EndLine":1,"StartColumn":2,"EndColumn":9,"Match":"","Secret":"abc","File":"f","RuleID":"r"}]')
    assert tuple(C.gitleaks(spark, str(tmp_path / "g.json")).first()) == ("gitleaks", "f", "abc", "V:1-1;H:2-9;", "r")
    (tmp_path / "t.json").write_text('{"Raw":"a","DetectorName":"D","Verified":true}{"RawV2":"b","Raw":"c"}\nbroken')
    assert sorted(r["match"] for r in C.trufflehog(spark, str(tmp_path / "t.json")).collect()) == ["a", "b"]
    (tmp_path / "k.json").write_text('noise\n{"findings_by_rule":[{"id":"k1","matches":[{"finding":{"path":"p","line":3,"snippet":"s"}}]}]}\n')
    assert tuple(C.kingfisher(spark, str(tmp_path / "k.json")).first()) == ("kingfisher", "p", "s", "3", "k1")
    (tmp_path / "d.json").write_text('{"results":{"f":[{"type":"Hex","line_number":2,"is_verified":false}]}}')
    lines = spark.createDataFrame([("f", 2, "text")], "file string, line_no int, text string")
    assert C.detect_secrets(spark, str(tmp_path / "d.json"), lines).first()["match"] == "text"
    (tmp_path / "p.json").write_text('{"f":[{"line":"l1"},{"line":"l1"}]}')
    assert C.deepsecrets(spark, str(tmp_path / "p.json")).count() == 1
    (tmp_path / "s.txt").write_text("f:3:abc\nxy\nlonger line\n")
    assert sorted(r["match"] for r in C.git_secrets(spark, str(tmp_path / "s.txt")).collect()) == ["abc", "longer line"]
    (tmp_path / "u.txt").write_text("https://github.com/a/b\n//https://github.com/c/d\n\nnope\n")
    assert [r.url for r in C.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://github.com/a/b"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = I.counters(I.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string", 1), "event_type", lateness="400 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    batch = I.counters(events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_flushes_each_new_address_once(spark, tmp_path):
    rows = [(f"u{i % 7}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "url string, at int").withColumn("ts", F.timestamp_seconds(F.col("at")))
    for k in range(3):
        df.where(F.col("at") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("u3",)], "url string")
    stream = I.new_candidates(I.event_stream(spark, str(tmp_path / "in"), "url string, at int, ts timestamp", 1), known, "url", "ts")

    def sink(batch, n):  # a batch that runs again writes the same folder
        batch.select("url").write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))

    for _ in range(2):  # the second run finds nothing new
        I.flushed(stream, sink, str(tmp_path / "cp")).awaitTermination()
    got = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [f"u{i}" for i in range(7) if i != 3]


def test_stream_sessions(spark):
    rows = [("a", 0), ("a", 60), ("a", 4000), ("b", 10)]
    df = spark.createDataFrame(rows, "k string, s int").withColumn("ts", F.timestamp_seconds(F.col("s")))
    assert sorted((r.k, r.n) for r in I.sessions(df, "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
