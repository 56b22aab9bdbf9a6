"""Toxicity, periodic runs and hard negatives against brute force, planted words and held-out labels, on odd tables."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

from leakloom.llm import hard_negatives, queries, runs, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, runs string, n_words int, score int, label int"
ODD = [None, "", " \n\t ", "one", "a " * 24, "a " * 23, "a b " * 12 + "c", "x a b c a b c a b c a b c a b c a b c a b c a b c y", "İ é 日本語 " * 30, "it's\x1c'S\x85 " * 9, "z" * 30000, "w\x0b" * 2000 + "v " * 500]


# periodic runs


def brute_runs(w, least=24, times=3):
    """All stretches of words that are those p words later, for every p: no grid, no suffixes."""
    names: dict = {}
    ids = np.array([names.setdefault(x, len(names)) for x in w])
    out = {}
    for p in range(1, len(w) // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([False], ids[:-p] == ids[p:], [False])).astype(np.int8)))
        for s, e in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            if e - s + p >= max(least, times * p):
                out.setdefault((s, e - s + p), p)
    return sorted((s, length, p) for (s, length), p in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(listed), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(200):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            n, kinds = rnd.choice([0, 1, 5, 23, 24, 30, 90, 250]), rnd.choice([1, 2, 3, 30])
            w = [rnd.randrange(kinds) for _ in range(n)]
            if n > 20 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 3 + 1))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        least, times = rnd.choice([(24, 3), (5, 2), (1, 2), (10, 4)])
        at = np.cumsum([0, *(len(t) for t in texts)])
        ids = np.array([x + 1000 * k for k, t in enumerate(texts) for x in t], np.int64)
        assert [tuple(r) for r in runs.runs_of(ids, at, least, times).tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, least, times)]


def test_extensions_are_those_of_comparing():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (40, 1), (300, 2), (500, 40)):
        ids = rng.integers(0, kinds, n)
        lce = runs.Extension(ids)
        i, k = rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400)
        i, k = i[i != k], k[i != k]

        def plain(a, b, ids=ids, n=n):
            m = 0
            while max(a, b) + m < n and ids[a + m] == ids[b + m]:
                m += 1
            return m

        assert lce(i, k).tolist() == [plain(a, b) for a, b in zip(i.tolist(), k.tolist(), strict=True)]


def test_op12_whole_query(spark, monkeypatch):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t, None, "r", 1, 2, 3) for i, t in real] + [(10**6 + i, t, "x", "r", 1, 2, 3) for i, t in enumerate(ODD * 10)] + [(None, "a " * 30, "x", "r", 1, 2, 3)] + [(7, "b " * 30, "x", "r", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    whole = sorted(brute_row(*r) for r in real)
    want = sorted([*whole, *(brute_row(r[0], r[1]) for r in rows[len(real) :])], key=repr)
    for pairs, together in ((runs.PAIRS, runs.TOGETHER), (1000, 200)):
        monkeypatch.setattr(runs, "PAIRS", pairs)
        monkeypatch.setattr(runs, "TOGETHER", together)
        got = runs.digests(runs.periodic_runs(runs.with_repeats(docs)))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(r[1] > 0 for r in want) > 60
    assert runs.digests(runs.periodic_runs(runs.with_repeats(docs.where("false")))).collect() == []
    assert sorted(tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()) == whole


# hard negatives

EMB = "vec_id long, embedding array<float>, label int, rank int, v string, key int, dim int, block int"


def brute_negatives(rows, every, positives, k, low, high, shift):
    seen = {}
    for i, e, y, *_ in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        seen[(i, (y + 1) % 10 if shift and i % 7 == 0 else y, v)] = 1
    all_, out = list(seen), []
    for a in all_:
        if a[0] % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in all_ if b != a and len(b[2]) == len(a[2]))
        for s, i, y in [o for o in others if o[2] == a[1]][:positives]:
            good = [o for o in others if o[2] != a[1] and -low * s <= -100 * o[0] <= -high * s]
            out += [(a[0], i, r + 1, o[1], -s, -o[0]) for r, o in enumerate(good[:k])]
    return sorted(out)


@pytest.mark.parametrize("leaf,tree,pack", [(512, 1 << 19, 1 << 14), (2, 300, 40)])
def test_hard_negatives(spark, monkeypatch, leaf, tree, pack):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "PACK", pack)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.3, 4).round(1).tolist(), int(rng.integers(0, 3) if i % 3 else 0)) for i in range(260)]  # coarse values: many ties
    rows += [(20, [1.0] * 4, 1), (20, [1.0] * 4, 1), (20, [1.0] * 4, 2), (40, None, 1), (60, [None, 1.0, 1.0, 1.0], 1), (80, [math.nan] * 4, 1), (100, [math.inf] * 4, 1), (120, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(300, [0.0] * 4, 9), (310, [2.0, 1.0], 4), (320, [1.0, 3.0], 4), (330, [1.0, 1.0], 5), (400, [], 1), (401, [], 1), (402, [], 2), (-20, [-1.0] * 4, 1), *((500 + i, [0.5] * 4, i % 2) for i in range(70))]
    rows = [(*r, 1, "x", 2, 3, 4) for r in rows]
    table = spark.createDataFrame(rows, EMB).repartition(3)
    got = hard_negatives.hard_negatives(table, every=10, positives=3, k=4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 3, 4, 30, 90, False)
    assert hard_negatives.hard_negatives(table.where("false")).collect() == []
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_op13_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect())) == brute_negatives(rows, 100, 5, 10, 30, 90, True)


def test_search_opens_few_leaves(monkeypatch):
    """Near-first search of clustered rows ends long before all rows are scored."""
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (200, 8)) + c for c in rng.integers(-4000, 4000, (40, 8))]).astype(np.float64)
    bound = float((x**2).sum(axis=1).max()) * (1 + hard_negatives.SLACK)
    labels = np.repeat(np.arange(40), 200) % 5
    blob = io.BytesIO()
    np.savez(blob, **hard_negatives.build(np.arange(len(x)), labels, x, bound))
    a = hard_negatives.Anchor(hard_negatives.opened(blob.getvalue()), x[17], 0, 17, bound)
    got = hard_negatives.first(5, a.nearest_first(True))
    scores = (x @ x[17]).astype(int)
    assert got == [(int(scores[i]), i) for i in sorted((i for i in range(len(x)) if labels[i] == 0 and i != 17), key=lambda i: (-scores[i], i))[:5]]
    leaves = sum(left < 0 for left in a.t["left"])
    assert len([k for k, _ in a.seen if a.t["left"][k] < 0]) < leaves / 3


def test_vectors_too_large_are_an_error(spark):
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(1, [1e30, 1e30], 0)], "vec_id long, embedding array<double>, label int"))
    big = [(i, [float(2**20 + i), 1.5], i % 2) for i in range(120)]  # beyond doubles, within longs
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    rows = [(i, e, y) for i, e, y in big]
    assert sorted(map(tuple, hard_negatives.hard_negatives(table).collect())) == brute_negatives(rows, 100, 5, 10, 30, 90, False)


def test_anchors_do_not_go_through_the_driver(spark):
    """Repeated for each tree they are many times what Spark takes them for, so no join here may be a broadcast."""
    table = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(300)], "vec_id long, embedding array<double>, label int")
    out = hard_negatives.hard_negatives(table)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 0


# toxicity


def test_subwords_are_the_words_and_their_grams():
    """Equal words have equal buckets wherever they stand, and a window's odds are the averages that the docstring tells of."""
    text = "Ärger, idiot-Idiot  x"
    buckets, owner, start = toxicity.subwords(text)
    assert [text[i:].split()[0][:5] for i in start.tolist()] == ["Ärger", "idiot", "Idiot", "x"]
    of = lambda k: sorted(buckets[owner == k].tolist())
    assert of(1) == of(2) != of(0)
    # <idiot>: itself, five of 3, four of 4, three of 5; <x>: itself and one of 3
    assert len(of(1)) == 1 + 5 + 4 + 3 and len(of(3)) == 2
    for other in ("idiot", "\nidiot\n", "ööö " * 50 + "idiot"):
        b, o, s = toxicity.subwords(other)
        assert sorted(b[o == len(s) - 1].tolist()) == of(1)


def test_long_texts_are_scored_as_short_ones(monkeypatch):
    model = toxicity.train(["you idiot there"] * 30 + ["you are there now"] * 30 + ["there we are"] * 30, np.array([1] * 30 + [0] * 60))
    texts = [None, "", "###", "you idiot", "there " * 3000 + "idiot " + "now " * 3000, "now are " * 250, "x" * 900 + " idiot", "İ" * 40 + " idiot"]
    whole = model.scores(texts)
    assert (whole[[3, 4]] > 0.5).all() and (whole[[0, 1, 2, 5]] < 0.5).all()
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.allclose(model.scores(texts)[[0, 1, 2, 3, 4, 5]], whole[[0, 1, 2, 3, 4, 5]])
    assert np.allclose([model.scores([t])[0] for t in texts[:6]], whole[:6])


def test_unseen_misspellings():
    rnd = random.Random(3)
    calm = ["".join(rnd.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    bad = ["idiot", "pathetic", "worthless", "disgusting"]
    texts = [" ".join(rnd.choices(calm, k=20)) for _ in range(300)]
    texts += [" ".join([*rnd.choices(calm, k=10), rnd.choice(bad), *rnd.choices(calm, k=10)]) for _ in range(300)]
    model = toxicity.train(texts, np.array([0] * 300 + [1] * 300))
    held = [" ".join([*rnd.choices(calm, k=30), w, *rnd.choices(calm, k=30)]) for w in ("idiott", "patthetic", "worthles", "disgustingg")]
    assert (model.scores(held) > 0.5).all()
    assert (model.scores([" ".join(rnd.choices(calm, k=60)) for _ in range(50)]) < 0.5).mean() > 0.95


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", None, "r", 1, 2, 3), (None, "c", None, "r", 1, 2, 3), (2, None, None, "r", 1, 2, 3)], DOCS)
    for rows, want in (([], 0), ([(1, 1, 0)], 0), ([(1, 1, 1)], 1), ([(1, 1, None), (None, 1, 1)], 0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = toxicity.predict(docs, toxicity.fit(docs, labels, ~toxicity.held_out(7))).collect()
        assert [r.predicted for r in got] == [want] * 3
    assert toxicity.predict(docs.where("false"), toxicity.fit(docs, labels, ~toxicity.held_out())).collect() == []


def test_op11_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op11_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got) and len(held) > 500
    # nearly half of the held-out toxic labels stand on texts without any of the planted words, mostly junk: only those with them can be known
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = [i for i in got if got[i].held_out and re.search(r"(?i)\b(loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid)\b", texts[i] or "")]
    assert len(planted) > 50 and sum(got[i].predicted for i in planted) / len(planted) > 0.95
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.7
    assert sum(p for p, y in held if not y) / sum(not y for _, y in held) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
