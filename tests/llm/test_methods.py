"""The methods of the ten operators against brute force: small domains, enumeration, exhaustive subsets, planted cases, odd tables."""

import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leakloom.llm import ann, bpe, common, langid, ngram_join, pii, quality, secrets, sharding

WORD = public_tokenizers.path("word_bpe_49k.json")


# words and scratch


def test_words_that_collide_under_powers_of_two():
    a = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    sets = list(ngram_join.shingle_sets([a, b, a[:64] + b[64:], a.upper()]))
    assert len({ngram_join.set_key(s) for s in sets}) == 3 and (sets[0] == sets[3]).all()


def test_word_hashes_cut_and_tell_apart():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab é\t\n\x1cZ"), rng.integers(0, 200))) + "x" * int(rng.integers(0, 90)) for _ in range(200)]
    w = common.word_hashes([t.encode() for t in texts])
    seen = {}
    for i, (a, b) in enumerate(itertools.pairwise(w.at.tolist())):
        words = [bytes(w.buf[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
        assert words == re.findall(rb"[^\x20\x09-\x0D]+", texts[i].encode().lower())
        for word, h in zip(words, w.h[a:b].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 300


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        common.shared_dir(Session)


# nearest neighbours


def best(rows, k, every):
    """rows (id, vector) -> {query: [(id, score)]}, an id's score the best over its and the query's vectors."""
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        top = {}
        for i, v in rows:
            for j, u in rows:
                if j == q and i != q:
                    top[i] = max(top.get(i, -np.inf), float(np.add.accumulate(np.array(u, float) * v)[-1]))
        out[q] = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_tile_keeps_k_ids(monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 7)
    for seed in range(1000):
        rng = np.random.default_rng(seed)
        k, n = int(rng.integers(1, 5)), int(rng.integers(1, 25))
        ids = rng.integers(0, 12, n)
        vec = rng.integers(-3, 4, (n, 3)).astype(float) if seed % 2 else rng.normal(size=(n, 3))
        vec[np.abs(vec).sum(axis=1) == 0] = 1
        mine = ids % 4 == 0
        got = {}
        for q, i, s in ann.top_of_tile(ids[mine], vec[mine], ids, vec, k):
            got.setdefault(q, {})
            got[q][i] = max(got[q].get(i, -np.inf), s)
        want = best(list(zip(ids.tolist(), vec, strict=True)), k, 4)
        for q, top in want.items():
            assert sorted(got.get(q, {}).items(), key=lambda x: (-x[1], x[0]))[:k] == top


def test_nearest_with_repeats_ties_and_odd_tables(spark):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 2.0]), (2, [2.0, 0.0]), (3, [2.0, 5.0]), (4, [1.0, 9.0]), (40, [0.0, 1.0]), (40, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    got = {}
    for r in ann.nearest(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == best([(i, np.array(v)) for i, v in rows], 3, 20) and [i for i, _ in got[20]] == [1, 2, 3]
    assert ann.nearest(df.where("false"), k=3).collect() == []
    alone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(alone, k=3).collect() == []


# pseudonyms

KEY = b"k"


def test_each_kind_permutes_a_small_domain():
    for size in (2, 3, 7, 64, 1000, 1025):
        assert sorted(pii.feistel(x, size, KEY, "t") for x in range(size)) == list(range(size))
    days = [f"2021-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    assert len({pii.date(x, KEY) for x in days}) == len(days)
    none = [f"2021-02-{d:02d}" for d in range(30, 100)]
    assert len({pii.date(x, KEY) for x in none} | {pii.date(x, KEY) for x in days}) == len(none) + len(days)
    cards = [f"453957876362{x:03d}" for x in range(1000)]
    whole = [c + next(d for d in "0123456789" if pii.luhn(c + d)) for c in cards]
    assert len({pii.card(c, KEY) for c in whole}) == 1000 and all(pii.luhn(pii.card(c, KEY)) for c in whole)
    wrong = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in whole]
    assert len({pii.card(c, KEY) for c in wrong}) == 1000 and not any(pii.luhn(pii.card(c, KEY)) for c in wrong)
    for kind, forms in {"phone": ["(212) 555-{:04d}"], "social": ["123-45-{:04d}"], "number": ["12345{:04d}", "212555{:04d}", "1234567{:04d}"], "address": ["9.8.{}.7"], "email": ["q{:03d}@z.org"]}.items():
        for form in forms:
            values = [form.format(x) for x in range(1, 200)]
            assert len({pii.KINDS[kind](v, KEY) for v in values}) == len(values)
    two = [a + b + "я" for a in "абвгд" for b in "αβγ"]
    assert len({pii.permute_string(x, KEY, "t") for x in two}) == len(two)


def test_dates_of_mixed_orders_stay_apart():
    """All days in forms that share a shape: no two become one, each keeps its reading, and what is no date stays none."""
    import datetime as dt

    days = [dt.date(1800, 1, 1) + dt.timedelta(k) for k in range(0, 109_572, 53)]
    for sep, wide in (("/", "02d"), (".", "02d"), ("-", "02d"), ("/", "d"), (".", "d")):
        forms = {f"{d.day:{wide}}{sep}{d.month:{wide}}{sep}{d.year}" for d in days} | {f"{d.month:{wide}}{sep}{d.day:{wide}}{sep}{d.year}" for d in days}
        forms |= {f"{x:02d}{sep}{y:02d}{sep}2001" for x in range(0, 100, 7) for y in range(0, 100, 3)}
        new = {f: pii.date(f, KEY) for f in forms}
        assert len(set(new.values())) == len(forms)
        orders = ("MDY", "DMY") if sep == "/" else ("DMY", "MDY")
        read = lambda f: next((o for o in orders if pii._day(o, list(map(int, f.split(sep)))) is not None), None)  # noqa: B023, E731
        assert all(read(f) == read(g) and [len(p) for p in f.split(sep)] == [len(p) for p in g.split(sep)] for f, g in new.items())
    iso = {d.isoformat() for d in days}
    assert len({pii.date(f, KEY) for f in iso}) == len(iso)
    # a date is the same day in all forms that any day can have
    assert dt.date.fromisoformat(pii.date("1967-04-23", KEY)).strftime("%m/%d/%Y") == pii.date("04/23/1967", KEY)
    # a whole small class is permuted onto itself: days over 12 of shape D/M/YYYY
    whole = {f"{d.day}/{d.month}/{d.year}" for d in (dt.date(1800, 1, 1) + dt.timedelta(k) for k in range(109_572)) if d.day > 12 and d.month < 10}
    assert {pii.date(f, KEY) for f in whole} == whole


def test_accounts_and_addresses_stay_apart():
    body = "0370400440532013"
    for n in (16, 8):
        tails = [f"{k:02d}" for k in range(100)]
        forms = [f"DE{c:02d}{body[:n]}{t}" for c in range(100) for t in tails[::9]]
        new = [pii.iban(f, KEY) for f in forms]
        assert len(set(new)) == len(forms) and [pii._account(f) for f in forms] == [pii._account(f) for f in new]
        assert sum(map(pii._account, forms)) == len(tails[::9]) and all(f[:2] == "DE" and len(f) == len(forms[0]) for f in new)
    assert pii.iban("DE89 3704 0044 0532 0130 00", KEY).replace(" ", "") == pii.iban("DE89370400440532013000", KEY)
    # all four-part strings of one shape, valid or not
    forms = [f"{a}.2{b}.{c:02d}.9" for a in (1, 9) for b in range(100) for c in range(100)]
    forms = [f for f in forms if len(f) == len(forms[-1])]
    new = [pii.address(f, KEY) for f in forms]
    assert len(set(new)) == len(forms) and all((pii._quad(f) is None) == (pii._quad(g) is None) for f, g in zip(forms, new, strict=True))
    small = [f"{a}.{b}.{c}.{d}" for a in (300, 256, 999) for b in range(10) for c in range(10) for d in range(10)]
    assert all(pii._quad(pii.address(f, KEY)) is None for f in small) and len({pii.address(f, KEY) for f in small}) == len(small)


def test_strings_of_all_scripts_and_lengths():
    for s in ("иван@пример.com", "Ёлка.petrov@mail.com", "Σίσυφος@όρος.gr", "иван@почта.рф", "日本語@例え.jp", "a1@xn--e1afmkfd.xn--p1ai", "ÀÉß@ü.de"):
        out, n = pii.pseudonymise_text(f"to {s} now", KEY)
        new = re.fullmatch(r"to (\S+) now", out)[1]
        assert n == {"email": 1} and len(new) == len(s) and new.rpartition(".")[2] == s.rpartition(".")[2]
        for old, c in zip(s.rpartition(".")[0], new, strict=False):
            assert (old in "@.-" and c == old) or pii.class_of(old) == pii.class_of(c)
        same = sum(a == b for a, b in zip(s.rpartition(".")[0], new, strict=False) if a not in "@.-")
        assert same < len(s) / 2
    long = "z" * 10**6
    out, n = pii.pseudonymise_text(long + "@a.com", KEY)
    assert n == {"email": 1} and len(out) == 10**6 + 6 and out != long + "@a.com" and pii.pseudonymise_text(long, KEY) == (long, {})
    # a block depends on all before it, and equal strings stay equal
    a, b = pii.permute_string("q" * 100, KEY, "t"), pii.permute_string("r" + "q" * 99, KEY, "t")
    assert a[32:] != b[32:] and a == pii.permute_string("q" * 100, KEY, "t") and len({a[:32], a[32:64], a[64:96]}) == 3


def test_numbers_without_separators():
    for text, kinds in {"078 05 1120": "social", "9885552485": "number", "078051120": "number", "03/14/1885": "date", "2021-02-30": "date", "98855524851": "number", "1.2.1999": "date"}.items():
        out, n = pii.pseudonymise_text(f"id {text}, ok", KEY)
        assert n == {kinds: 1} and out != f"id {text}, ok" and re.sub(r"\d", "0", out).replace("00", "0") == re.sub(r"\d", "0", f"id {text}, ok").replace("00", "0")
    for plain in ("0.123456789", "12345678", "v1.2", "x9885552485", "100,000,000,000"):
        assert pii.pseudonymise_text(plain, KEY) == (plain, {})
    assert pii.pseudonymise_text("988-555-2485 or 9885552485", KEY)[0].replace("-", "")[:10] == pii.pseudonymise_text("9885552485", KEY)[0]


# language ID


def crf(n, seed):
    rng = np.random.default_rng(seed)
    return langid.Crf([chr(97 + i) for i in range(n)], np.zeros((1, n)), rng.normal(size=(n, n)), rng.normal(size=n), [])


def test_posteriors_equal_enumeration():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n, sizes = 2 + seed % 2, [int(x) for x in rng.integers(0, 6, 4)]
        m, at = crf(n, seed), np.cumsum([0, *sizes])
        em = rng.normal(size=(sum(sizes), n)) * 3
        want = np.zeros_like(em)
        for a, b in itertools.pairwise(at.tolist()):
            total = 0.0
            for path in itertools.product(range(n), repeat=b - a):
                if path:
                    w = np.exp(m.starts[path[0]] + sum(em[a + i, y] for i, y in enumerate(path)) + sum(m.transitions[x, y] for x, y in itertools.pairwise(path)))
                    total += w
                    for i, y in enumerate(path):
                        want[a + i, y] += w
            want[a:b] /= total or 1
        got = langid.posteriors(em, at, m)
        assert np.allclose(got, want, atol=1e-9)
        assert np.allclose(langid.means(got, at), [want[a:b].mean(axis=0) if b > a else np.zeros(n) for a, b in itertools.pairwise(at.tolist())])


def test_word_lists_and_labels(spark):
    en = [f"the house number{i} of the old town stands there" for i in range(12)]
    de = [f"das haus nummer{i} der alten stadt steht dort" for i in range(12)]
    m = langid.train(en + de, ["en"] * 12 + ["de"] * 12)
    w = langid._words([b"haus house neither"])
    assert m.labels == ["de", "en"] and langid.listed(w.h, m.lists).tolist()[:2] == [[True, False], [False, True]] and not langid.listed(w.h, m.lists)[2].any()
    df = spark.createDataFrame([(1, "the old house. das alte haus steht dort der stadt"), (2, None), (3, "12 !"), (None, "town")], "doc_id long, text string")
    got = {r.doc_id: [(x.lang, x.first, x.n_words) for x in r.runs] for r in langid.label_words(df, m).collect()}
    assert got[1] == [("en", 0, 3), ("de", 3, 7)] and got[2] == got[3] == [] and got[None] == [("en", 0, 1)]
    assert all(r.runs == [] for r in langid.label_words(df, langid.train([], [])).collect())


def test_copies_don_t_crowd_out_languages(spark, monkeypatch):
    rows = [("en", "the same words again and again")] * 3000 + [("en", f"other words are here as well {i}") for i in range(40)] + [("fr", f"les mots de la langue numero {i}") for i in range(40)]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert langid.fit(df).labels == ["en", "fr"]
    p = {r.doc_id: r.lang_pred for r in langid.predict(df.where("doc_id > 2990"), langid.fit(df)).collect()}
    assert p[2995] == "en" and p[3079] == "fr"
    monkeypatch.setattr(langid, "MAX_LABELS", 1)
    with pytest.raises(ValueError):
        langid.fit(df)


def test_mixed_text_is_labelled_by_word(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(real, ~langid.held_out())
    rng, by = np.random.default_rng(4), {}
    for r in real.where(langid.held_out() & F.expr("length(text) > 600")).orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    right = total = 0
    for _ in range(60):
        texts, truth = [], []
        for _ in range(6):
            lang = m.labels[rng.integers(len(m.labels))]
            t = by[lang][rng.integers(len(by[lang]))]
            at = int(rng.integers(len(t) - 200))
            own = t[at : at + 200].partition(" ")[2].rpartition(" ")[0] + " "
            texts.append(own)
            truth += [m.labels.index(lang)] * len(langid._words([own.lower().encode()]).h)
        w = langid._words(["".join(texts).lower().encode()])
        got = langid.posteriors(langid.emissions(w, m), w.at, m).argmax(axis=1)
        right, total = right + int((got == truth).sum()), total + len(truth)
    assert right / total > 0.9, right / total


# quality rules


def test_least_determinant_equals_all_subsets(spark):
    scratch = common.Scratch(spark)
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(12, 2)) @ np.array([[1.0, 0.8], [0.0, 0.6]])
        x[:3] += [6, -5]
        rows = [(f"g{seed}", *map(float, r)) for r in x]
        state = quality.least_determinant(spark.createDataFrame(rows, "g string, x0 double, x1 double"), ["g"], ["x0", "x1"], [F.min(F.lit(0.0))] * 2, scratch, least=5).first()
        h = 9
        sub = min(itertools.combinations(range(12), h), key=lambda s: np.linalg.det(np.cov(x[list(s)].T, bias=True)))
        assert np.allclose([state.m0, state.m1], x[list(sub)].mean(axis=0), atol=1e-9)


def test_junk_is_rejected_and_plain_text_stays(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(800)]

    def plain(n):
        words = rng.choice(vocabulary, n)
        return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))

    rows = [(i, plain(int(rng.integers(60, 900))), "en", "s") for i in range(400)]
    rows += [(1000 + i, "\n".join(plain(6) for _ in range(3)) + "\n" + "\n".join(["menu home"] * 60 + [f"x{k} y{k}" for k in range(2)]), "en", "s") for i in range(5)]
    rows += [(2000 + i, " ".join(w + "##%%" for w in rng.choice(vocabulary, 100)), "en", "s") for i in range(5)]
    rows += [(3000, plain(200) + "\n" + plain(30) * 1, None, None), (3001, None, "en", "s"), (3002, plain(100), "xx", "t")]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string")).collect()}
    assert sum(got[i].kept for i in range(400)) >= 398
    assert not any(r.kept for i, r in got.items() if 1000 <= i < 3000)
    assert got[3000].kept and got[3000].distance is None and not got[3001].kept and got[3002].kept


# secrets


def test_secrets_in_odd_tables(spark):
    many = " ".join(f"AKIA{i:014d}" for i in range(1500))
    rows = [(1, many, 7, "x"), (None, "é" * 70000 + " token: abcdefghijklmnop", 1, "y"), (2, None, 1, "z"), (2, None, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob int, spans string")
    ledger = secrets.scan_ledger(df)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.s] for r in secrets.secret_findings(df, ledger).select("doc_id", F.col("spans").alias("s")).collect()}
    assert got[1] == [x for m in re.finditer("AKIA[0-9]+", many) for x in [("access", m.start(), m.end())]] and len(got[1]) == 1500
    assert got[None] == [("assign", 70001, 70024)] and got[2] == []
    assert secrets.secret_findings(df.where("false"), secrets.scan_ledger(df.where("false"))).collect() == []


# BPE


def test_digests_equal_the_library_s(spark, monkeypatch):
    tok = Tokenizer.from_file(WORD)
    texts = [None, "", "It's 5 o'clock <|endoftext|> now<|endof", "naïve café ﬁ 日本語 5²½\x00q", "word " * 3000, "z" * 5000, *(f"number {i} of texts" for i in range(40))]
    df = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, part int, ids string").repartition(3)
    for chars in (1 << 25, 100):  # one list a task, and many
        monkeypatch.setattr(bpe, "PART_CHARS", chars)
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(df, WORD).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert got[i if i else None] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert bpe.bpe_encode_decode(df.where("false"), WORD).collect() == []


def test_pack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        v = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (bpe.unpack(bpe.pack(v)) == v).all() and len(bpe.unpack(bpe.pack(v))) == n


def test_budgets_are_answered_from_the_table(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "short", "a few words of text,\n\n  and more é日本 " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fits_bytes for r in bpe.prefix_token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), keep_table=False, budget=37).collect()}
    for i, t in enumerate(texts):
        fit = [k for k in range(len(t or "") + 1) if len(tok.encode((t or "")[:k], add_special_tokens=False).ids) <= 37]
        assert got[i] == len((t or "")[: max(fit)].encode())
    with pytest.raises(ValueError):
        bpe.PrefixCounter(WORD)


# shards


def test_groups_of_equal_texts_stay_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["x" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 60, 150))]
    rows = [(int(i), texts[rng.integers(150)]) for i in range(900)] + [(2000 + i, "hot " * 20) for i in range(400)] + [(None, None), (3000, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, shard int, group string").repartition(5)
    monkeypatch.setattr(sharding, "WHOLE", 8)
    got = sharding.shard_by_bytes(df, 6, groups=True).collect()
    key = lambda i, t: (hashlib.md5((t or "").encode()).digest(), i is not None, i or 0)
    order = sorted(rows, key=lambda r: key(*r))
    size = [len((t or "").encode()) + 8 for _, t in order]
    total, at, want, spans = sum(size), 0, [], {}
    for (_, t), n in zip(order, size, strict=True):
        first, last, k = spans.get(t or "", (at, at, 0))
        spans[t or ""], at = (first, at + n, k + 1), at + n
    at = 0
    for (i, t), n in zip(order, size, strict=True):
        first, last, k = spans[t or ""]
        middle = first + last if k > 1 and (last - first) * 8 * 6 <= total else 2 * at + n
        want.append((i, min(middle * 6 // (2 * total), 5)))
        at += n
    assert sorted(((r.doc_id, r.shard) for r in got), key=str) == sorted(want, key=str)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by = {}
    for r in got:
        by.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sum(len(x) > 1 for x in by.values()) <= 5 and len(by[next((r.text_crc32, r.size) for r in got if r.doc_id == 2000)]) > 1
    assert sharding.shard_by_bytes(df.where("false"), 6, groups=True).collect() == []


# beyond the sizes that are broadcast


def test_results_don_t_depend_on_what_is_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def run():
        links = sorted(map(tuple, ngram_join.ngram_jaccard_members(docs).collect()))
        verdicts = sorted((r.doc_id, r.kept, None if r.distance is None else round(r.distance, 6)) for r in quality.quality_verdicts(docs).collect())
        shards = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 24, groups=True).collect())
        return links, verdicts, shards

    small = run()
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 5)  # gatherings of several blocks
    for module, name in ((ngram_join, "FEW"), (ngram_join, "FEW_BYTES"), (quality, "FEW"), (sharding, "RANGES")):
        monkeypatch.setattr(module, name, 0)
    assert run() == small


def test_pipeline_runs_and_its_verdicts_are_the_operators(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in P.rules(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in quality.quality_verdicts(docs).collect() if r.kept}
    model = langid.fit(docs, ~langid.held_out())
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs.withColumn("score", F.lit("x")), model).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert quality.kept_documents(docs.where("false")).collect() == [] and langid.identified(docs.where("false"), model).collect() == []
    out = P.run(spark, "/root/testdata/sf0.001").collect()
    left = {r.doc_id for r in out}
    assert 50 < len(left) < 200 and all(r.length <= 2048 for r in out)


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = lambda df: {r.doc_id: (r.kept, r.distance) for r in quality.quality_verdicts(df).collect()}
    one = by(docs.coalesce(1))
    assert one == by(docs.repartition(7, "doc_id")) and len(one) == docs.count()


def test_extra_columns_of_any_name(spark):
    import corpus_pipeline as P

    names = ("__p", "__c", "__d", "_row", "_key", "__o", "__group", "lang_k", "component", "n_words", "kept", "row_key")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = rows.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    plain = {n: sorted(r.doc_id for r in f(spark, rows, "").collect()) for n, f in P.STAGES}
    for n, f in P.STAGES:
        out = f(spark, docs, "")
        got = out.collect()
        assert sorted(r.doc_id for r in got) == plain[n]
        if n != "best_fit_packing":
            assert out.columns == docs.columns and all(r[x] == i for r in got for i, x in enumerate(names))
