"""The stages of corpus_pipeline against brute force on small tables with null and repeated ids."""

import zlib

import corpus_pipeline as P
import public_tokenizers
import pytest

from leakloom.llm import bpe, langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def by(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 3000 and lang is not null")
    return {r.lang: r.text for r in real.dropDuplicates(["lang"]).collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language(spark, by, monkeypatch):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(real, ~langid.held_out())
    monkeypatch.setattr(P.langid, "fit", lambda *_: model)
    mixed = " ".join(t[:700] for t in by.values())
    rows = [(1, mixed, None), (None, mixed, "en"), (2, "123 ...", "en"), (2, mixed[:900], "fr"), (2, mixed[:900], "fr"), (None, None, "en")]
    out = P.language(spark, table(spark, rows), "")
    assert got(out) == sorted([(1, mixed), (None, mixed), (2, mixed[:900]), (2, mixed[:900])], key=str)
    assert all(r.lang is not None for r in out.collect())


def test_rules(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en"), (None, words, "en"), (2, words, "en"), (2, "too short", "en"), (None, "short", "en")]
    assert got(P.rules(spark, table(spark, rows), "")) == sorted([(1, words), (None, words), (2, words)], key=str)


def test_near_duplicates(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "en"), (3, a + " end", "en"), (None, a, "en"), (7, b, "en"), (7, c, "en"), (7, c, "en"), (None, "alone and without an id", "en")]
    assert got(P.near_duplicates(spark, table(spark, rows), "")) == sorted([(3, a + " end"), (7, b), (7, c), (None, "alone and without an id")], key=str)


def test_pseudonyms_and_packing(spark):
    rows = [(1, "mail a.b7@mail8.example.com now", "en"), (None, "plain text", "en"), (1, "plain text", "en")]
    df = table(spark, rows)
    out = P.pseudonyms(spark, df, "").collect()
    assert len(out) == 3 and all("a.b7@mail8" not in r.text and r.n_chars == len(r.text) for r in out)
    words = bpe.WordTable(public_tokenizers.path(P.WORD_BPE))
    want = sorted(((i, zlib.crc32(words.ids(t) + b"\0\0\0\0")) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.ids_crc32) for r in P.packed(spark, df, "").collect()), key=str) == want
