"""Language ID by a linear-chain conditional random field over words.

A word's features are its whole form, affixes and byte n-grams (hashed), and lexicon entries: membership in each language's
word list, or in none. Learned transitions tie neighbouring words, so code-switched text is labelled in runs.
A document's score for a language is the mean of its words' marginals, by forward-backward over the whole text.
The model is fitted on a bounded sample of labelled documents; mixed sequences are cut from it to learn switches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashed, free_name, map_documents, pieces, with_columns, with_struct, word_hashes

#: Bounds of the fitting sample: documents and bytes of each a language.
SAMPLE_DOCS, SAMPLE_BYTES = 250, 2500
#: Languages that a model can hold (half a megabyte each); more are an error.
MAX_LABELS = 1000
#: Documents of the sample that a word of a language's list is in at least.
LISTED = 2
#: Hashed feature rows.
FEATURE_BITS = 17
#: Words whose lattices are worked through together.
LATTICE_WORDS = 400_000
STEPS, BATCH, LENGTH = 240, 64, 48

_APART = np.ones(256, bool)
_APART[ord("a") : ord("z") + 1] = False
_APART[0x80:] = False


class Crf(NamedTuple):
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    #: each language's word list, as sorted hashes
    lists: list[np.ndarray]


def _words(run: list[bytes]) -> Hashed:
    return word_hashes(run, lower=False, space=_APART)


def lowered(texts: Iterable[str | None]) -> list[str]:
    return ["" if t is None else t.lower() for t in texts]


def features(w: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature row) pairs: whole form, prefixes and suffixes of 1 to 4 bytes, n-grams of 2 to 4 bytes."""
    size, mask = w.end - w.start, np.uint64((1 << FEATURE_BITS) - 1)
    index, rows = [np.arange(len(size))], [w.h]

    def add(who: np.ndarray, at: np.ndarray, n: int, salt: int) -> None:
        index.append(who)
        rows.append(w.gram(at, n, salt))

    for k in range(1, 5):
        who = np.flatnonzero(size >= k)
        add(who, w.start[who], k, k)
        add(who, w.end[who] - k, k, 8 + k)
    own = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start, size)
    for n in range(2, 5):
        ok = at + n <= np.repeat(w.end, size)
        add(own[ok], at[ok], n, 16 + n)
    return np.concatenate(index), (np.concatenate(rows) & mask).astype(np.int64)


def listed(h: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """words x languages: whether the language's list has the word."""
    out = np.zeros((len(h), len(lists)), bool)
    for k, own in enumerate(lists):
        if len(own):
            out[:, k] = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h
    return out


def lexicon(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature row) pairs of memberships; the last row is that of words in no list."""
    index, k = np.nonzero(np.column_stack([member, ~member.any(axis=1)]))
    return index, (1 << FEATURE_BITS) + k


def emissions(w: Hashed, model: Crf) -> np.ndarray:
    """Score of each label for each word; each distinct word is scored once."""
    n = len(model.labels)
    if not len(w.h):
        return np.zeros((0, n), np.float32)
    _, first, back = np.unique(w.h, return_index=True, return_inverse=True)
    own = w._replace(h=w.h[first], start=w.start[first], end=w.end[first])
    out = np.zeros((len(first), n), np.float32)
    for index, rows in (features(own), lexicon(listed(own.h, model.lists))):
        for k in range(n):
            out[:, k] += np.bincount(index, model.weights[:, k][rows], len(first))
    return out[back]


def posteriors(em: np.ndarray, at: np.ndarray, model: Crf) -> np.ndarray:
    """Marginal of each label for each word, by forward-backward over the sequences em[at[i]:at[i+1]], side by side."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    longest, n = int(size[0]) if len(size) else 0, len(size)
    live = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    e = np.exp(em - em.max(axis=1, keepdims=True)) if len(em) else em
    t, s = np.exp(model.transitions), np.exp(model.starts)
    alpha = np.empty_like(e)
    for k in range(longest):
        p = first[: live[k]] + k
        a = e[p] * (s if k == 0 else alpha[p - 1] @ t)
        alpha[p] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((n, em.shape[1]))
    for k in range(longest - 1, -1, -1):
        m = live[k]
        p = first[:m] + k
        g = alpha[p] * beta[:m]
        alpha[p] = g / g.sum(axis=1, keepdims=True)
        b = (e[p] * beta[:m]) @ t.T
        beta[:m] = b / b.sum(axis=1, keepdims=True)
    return alpha


def means(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of rows[at[i]:at[i+1]]; 0 for none."""
    out, size = np.zeros((len(at) - 1, rows.shape[1])), np.diff(at)
    if len(rows):
        some = size > 0
        out[some] = np.add.reduceat(rows, at[:-1][some], axis=0, dtype=np.float64) / size[some][:, None]
    return out


def train(texts: list[str], langs: list[str], seed: int = 7) -> Crf:
    """Stochastic gradient (AdaGrad) on the log-likelihood of mixed sequences cut from the sample."""
    labels = sorted(set(langs))
    rng, n = np.random.default_rng(seed), max(len(labels), 1)
    runs = [(first, _words(run)) for first, run in pieces(lowered(texts))]
    # word lists: how many documents of a language a word is in
    seen = [(labels.index(langs[first + i]), np.unique(w.h[a:b])) for first, w in runs for i, (a, b) in enumerate(zip(w.at[:-1], w.at[1:], strict=True))]
    counts = [np.unique(np.concatenate([h for k, h in seen if k == own] or [np.zeros(0, np.uint64)]), return_counts=True) for own in range(n)]
    lists = [words[many >= LISTED] for words, many in counts]
    # a document doesn't count for its own words
    others = [words[many > LISTED] for words, many in counts]
    em_index, label_of, sizes = [], [], []
    base = 0
    for first, w in runs:
        own = np.concatenate([np.full(b - a, labels.index(langs[first + i])) for i, (a, b) in enumerate(zip(w.at[:-1], w.at[1:], strict=True))])
        member, strict = listed(w.h, lists), listed(w.h, others)
        member[np.arange(len(own)), own] = strict[np.arange(len(own)), own]
        index, rows = map(np.concatenate, zip(features(w), lexicon(member), strict=True))
        order = np.argsort(index, kind="stable")
        em_index.append((rows[order], np.bincount(index, minlength=len(w.h))))
        label_of.append(own)
        sizes += np.diff(w.at).tolist()
        base += len(w.h)
    weights, t, s = np.zeros(((1 << FEATURE_BITS) + n + 1, n)), np.eye(n) * 2.0, np.zeros(n)
    if base:
        rows = np.concatenate([r for r, _ in em_index])
        many = np.concatenate([c for _, c in em_index])
        start = np.concatenate(([0], np.cumsum(many)))
        truth = np.concatenate(label_of)
        docs = [(a, a + z) for a, z in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True) if z]
        by = [[d for d in docs if truth[d[0]] == k] for k in range(n)]
        by = [b for b in by if b]
        gw, gt = np.full_like(weights, 1e-2), np.full_like(t, 1.0)
        for _ in range(STEPS):
            seqs = np.zeros((BATCH, LENGTH), np.int64)
            for b in range(BATCH):
                got: list[int] = []
                while len(got) < LENGTH:
                    a, z = (own := by[rng.integers(len(by))])[rng.integers(len(own))]
                    run = int(rng.integers(6, LENGTH + 1))
                    a += int(rng.integers(max(1, z - a - run + 1)))
                    got += range(a, min(a + run, z))
                seqs[b] = got[:LENGTH]
            flat = seqs.ravel()
            feat = np.concatenate([rows[start[i] : start[i + 1]] for i in flat])
            who = np.repeat(np.arange(len(flat)), many[flat])
            em = np.stack([np.bincount(who, weights[:, k][feat], len(flat)) for k in range(n)], axis=1).reshape(BATCH, LENGTH, n)
            y = truth[seqs]
            alpha, beta = np.empty_like(em), np.ones_like(em)
            e, et = np.exp(em - em.max(axis=2, keepdims=True)), np.exp(t)
            for k in range(LENGTH):
                a = e[:, k] * (np.exp(s) if k == 0 else alpha[:, k - 1] @ et)
                alpha[:, k] = a / a.sum(axis=1, keepdims=True)
            pair = np.zeros((n, n))
            for k in range(LENGTH - 1, 0, -1):
                b = e[:, k] * beta[:, k]
                xi = alpha[:, k - 1][:, :, None] * et[None] * b[:, None, :]
                pair += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = b @ et.T
                beta[:, k - 1] = b / b.sum(axis=1, keepdims=True)
            g = alpha * beta
            g /= g.sum(axis=2, keepdims=True)
            g[np.arange(BATCH)[:, None], np.arange(LENGTH)[None], y] -= 1
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = g.reshape(-1, n) / BATCH
            touched, back = np.unique(feat, return_inverse=True)
            grad = np.stack([np.bincount(back, g[:, k][who], len(touched)) for k in range(n)], axis=1) + 1e-4 * weights[touched]
            gw[touched] += grad**2
            weights[touched] -= 0.3 * grad / np.sqrt(gw[touched])
            pair = pair / BATCH + 1e-3 * t
            gt += pair**2
            t -= 0.1 * pair / np.sqrt(gt)
    return Crf(labels, weights.astype(np.float32), t, s, lists)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(documents: DataFrame, train_on: Column | None = None) -> Crf:
    """A model from about SAMPLE_DOCS different texts of each language, of each a window of SAMPLE_BYTES characters, chosen by hash.

    Only text and lang of rows that ``train_on`` selects are read; rows with null or empty lang or text don't count, and
    copies of a text count once. More than MAX_LABELS languages are an error."""
    rows = documents.where((train_on if train_on is not None else F.lit(True)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not counts:
        return train([], [])
    window = F.substring("text", F.lit(1) + (F.col("h") % F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(1))).cast("int"), F.lit(SAMPLE_BYTES))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, SAMPLE_DOCS * (1 << 30) // n)))
    picked = rows.where(F.col("h") < share[F.col("lang")]).groupBy("lang", "h").agg(F.min(window).alias("text")).collect()
    got = sorted(picked, key=lambda r: (r["h"], r["lang"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


def _lattices(texts: list[str], model: Crf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(marginals of words, each text's first word and the end) of about LATTICE_WORDS words; texts stay whole."""
    em, sizes, n = [], [], 0
    for _, run in pieces(texts):
        w = _words(run)
        em.append(emissions(w, model))
        sizes += np.diff(w.at).tolist()
        n += len(w.h)
        if n > LATTICE_WORDS:
            at = np.cumsum([0, *sizes])
            yield posteriors(np.concatenate(em), at, model), at
            em, sizes, n = [], [], 0
    if sizes:
        at = np.cumsum([0, *sizes])
        yield posteriors(np.concatenate(em), at, model), at


def _predictions(texts: Iterable[str | None], model: Crf) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    texts, rows = lowered(texts), []
    for mean in (means(*x) for x in _lattices(texts, model)) if model.labels else ():
        rows += [(model.labels[k], float(s)) if s > 0 else ("und", 0.0) for k, s in zip(mean.argmax(axis=1).tolist(), mean.max(axis=1).clip(0, 1).tolist(), strict=True)]
    rows = rows or [("und", 0.0)] * len(texts)
    return [r if t.isascii() or any(map(str.isalpha, t)) else ("und", 0.0) for r, t in zip(rows, texts, strict=True)]


def predict(documents: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score: whole texts only are read. Null or letterless texts are ``und`` with score 0, as is all
    if the model knows no language. Ties go to the first label in order. Repeated rows stay. A very long text takes some
    20 bytes for each word and language in its worker."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, scores = zip(*_predictions(pdf["text"], held.value), strict=True)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": langs, "score": scores})

    return map_documents(with_columns(documents, doc_id="long", text="string"), run, "doc_id long, lang_pred string, score double")


def identified(documents: DataFrame, model: Crf) -> DataFrame:
    """All columns of documents, lang_pred and score as predict gives them: each row its own, and no text is shuffled.
    Columns of these names are replaced."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    own = documents.drop("lang_pred", "score")
    name = free_name(own, "__p")
    found = with_struct(own, lambda texts: _predictions(texts, held.value), name, "lang_pred: string, score: double")
    return found.select(*(F.col(f"`{c}`") for c in own.columns), f"{name}.*")


def label_words(documents: DataFrame, model: Crf) -> DataFrame:
    """doc_id, runs array<struct<lang, first, n_words>>: whole texts in runs of words with the same likeliest label, in order.

    Words are maximal runs of letters (of all but ASCII: of characters), counted from 0. Null or letterless texts have no
    runs, as have all if the model knows no language. Repeated rows stay."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def runs(best: np.ndarray) -> list[dict]:
        cut = np.flatnonzero(np.diff(best, prepend=-1, append=-1))
        return [{"lang": held.value.labels[best[a]], "first": int(a), "n_words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [runs(g[a:b].argmax(axis=1)) if b > a else [] for g, at in (_lattices(lowered(pdf["text"]), held.value) if held.value.labels else ()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "runs": out or [[]] * len(pdf)})

    return map_documents(with_columns(documents, doc_id="long", text="string"), run, "doc_id long, runs array<struct<lang: string, first: int, n_words: int>>")
