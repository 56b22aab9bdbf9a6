"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A word is the bag of itself and its character n-grams of 3 to 5 (with a mark at either end), hashed into BUCKETS rows of an embedding
table; so a misspelling that training never saw shares most rows with the word it stands for. The rows of all
words in a window of WINDOW words are averaged, word by word, and a softmax over linear scores judges the window;
a text is as toxic as its most toxic window, so length doesn't thin out what is there; the window of no words, whose average is 0,
is one of every text. Embeddings and softmax are trained together, by
gradient steps over all windows that decide: of each text the one that scores highest at that step. As averaging
and scoring are linear, a trained model comes down to one number a bucket: that is what workers get.

Words are maximal runs of letters, digits and marks, lower-cased; all other characters part words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_documents, mix, with_columns

#: Rows of the embedding table, its width, n-grams, words of a window.
BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 18, 12, (3, 4, 5), 4
#: Labelled documents of each class that training sees, and their longest text in characters: the bound of what the driver holds.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 10_000
#: Characters hashed at once; a longer text is cut behind a word, a longer word within.
PIECE = 1 << 18
#: Gradient steps, their rate, and the pull of embeddings to 0: what few texts say stays small.
STEPS, RATE, SHRINK = 60, 0.1, 3e-2
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is it part of a word, by code below 2^16; powers of the hash's base and of its inverse)."""
    of_word = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(1 << 16)])
    up, down = np.full(2 * PIECE + 8, _P, np.uint64), np.full(2 * PIECE + 8, _P_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return of_word, np.cumprod(up), np.cumprod(down)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and word of each subword, first character of each word) of a piece of at most 2 * PIECE characters."""
    codes = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), "<u4")
    of_word, up, down = _parts()
    up, down = (up, down) if len(codes) + 8 <= len(up) else (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes) + 7, _P)))), np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes) + 7, _P_INVERSE)))))
    inside = np.concatenate(([False], of_word[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), [False]))
    marked = np.where(inside, np.concatenate(([0], codes, [0])), 0x20).astype(np.uint64)
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    # sums of code * base^place: a difference of two, taken down to place 0, is the hash of what lies between
    total = np.concatenate(([np.uint64(0)], np.cumsum((marked + np.uint64(1)) * up[: len(marked)])))
    between = lambda a, b, n: mix((total[b] - total[a]) * down[a] + np.uint64(n)) & np.uint64(BUCKETS - 1)
    word = np.cumsum(np.bincount(start, minlength=len(inside)).astype(np.int64)) - 1
    outside = np.concatenate(([0], np.cumsum(~inside)))
    buckets, owner = [between(start, end, 0)], [np.arange(len(start))]
    for n in GRAMS:
        a = np.arange(max(len(inside) - n + 1, 0))
        a = a[outside[a + n - 1] == outside[a + 1]]  # only the ends may be marks
        buckets.append(between(a, a + n, n))
        owner.append(word[a + 1])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner), start - 1


def pieces(texts: list[str | None]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of whole texts, joined by line feeds, with (text, its first character) each; a text longer than a piece comes in parts."""
    run: list[str] = []
    at: list[tuple[int, int]] = []
    size = 0
    for k, t in enumerate(texts):
        t = t or ""
        i = 0
        while i < len(t):
            if size >= PIECE:
                yield "\n".join(run), at
                run, at, size = [], [], 0
            j = min(len(t), i + PIECE)
            if j < len(t):
                j = max((t.rfind(c, i, j) + 1 for c in " \n\t"), default=0) or j
                j = j if j > i else min(len(t), i + PIECE)
            run.append(t[i:j])
            at.append((k, size))
            size += j - i + 1
            i = j
    if run:
        yield "\n".join(run), at


@dataclass(frozen=True)
class Model:
    """``bucket``: what each row of the embedding table adds to the log-odds of class 1; ``bias``: the log-odds of no words."""

    bucket: np.ndarray
    bias: float

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of each word without bias, its first character)."""
        buckets, owner, start = subwords(text)
        n = len(start)
        total = np.bincount(owner, self.bucket[buckets], n)
        return total / np.maximum(np.bincount(owner, minlength=n), 1), start

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1 of each text's most toxic window; at least that of the bias."""
        held: dict[int, list[np.ndarray]] = {}
        for text, at in pieces(texts):
            values, start = self.words(text)
            cut = np.searchsorted(start, [c for _, c in at] + [len(text) + 1])
            for (k, _), a, b in zip(at, cut[:-1], cut[1:], strict=True):
                held.setdefault(k, []).append(values[a:b])
        out = np.full(len(texts), self.bias)
        for k, parts in held.items():
            v = np.concatenate(parts)
            if len(v):
                out[k] += max(top_window(v)[0], 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def lowered(text: str) -> str:
    """The text in lower case, but for characters whose lower case has another length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def top_window(values: np.ndarray) -> tuple[float, int, int]:
    """(mean, first, last plus one) of the window of WINDOW words (all, if fewer) with the largest mean."""
    w = min(WINDOW, len(values))
    total = np.concatenate(([0.0], np.cumsum(values)))
    mean = (total[w:] - total[:-w]) / w
    i = int(mean.argmax())
    return float(mean[i]), i, i + w


def _of_words(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, word by word, how many each has)."""
    buckets, sizes = [], []
    for i in range(0, len(names), 20_000):
        own, owner, start = subwords("\n".join(names[i : i + 20_000]))
        buckets.append(own[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(start)))
    return np.concatenate(buckets), np.concatenate(sizes)


def train(texts: list[str], toxic: np.ndarray, seed: int = 42) -> Model:
    """Embeddings and softmax, by Adam over the deciding windows of all texts; both classes weigh the same."""
    # distinct words, and the buckets of each
    names: dict[str, int] = {}
    docs = []
    gaps = dict.fromkeys(np.flatnonzero(~_parts()[0]).tolist(), " ")
    for t in texts:
        docs.append(np.array([names.setdefault(w, len(names)) for w in lowered(t).translate(gaps).split(" ") if w], np.int32))
    keep = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in keep], np.asarray(toxic, np.int64)[keep]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float64), 40.0 if len(y) and y[0] == 1 else -40.0)
    local, size = _of_words(list(names))
    del names
    held = np.zeros(BUCKETS, bool)
    held[local] = True
    own = np.flatnonzero(held)
    local = (np.cumsum(held, dtype=np.int32) - 1)[local]
    head = np.cumsum(size) - size
    tokens, at = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    width = np.minimum(WINDOW, np.diff(at))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(own), WIDTH))
    weight, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, weight, bias)]
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    ids = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(at))
    offset, wide = np.arange(WINDOW), width[ids].astype(np.int32)
    behind = np.arange(len(tokens), dtype=np.int32) + wide
    outside = behind > at[ids + 1]
    for step in range(1, STEPS + 1):
        # the deciding window of each text, by the log-odds of its words
        odds = np.add.reduceat((table @ (weight[:, 1] - weight[:, 0])).astype(np.float32)[local], head, dtype=np.float64) / size
        total = np.concatenate(([0.0], np.cumsum(odds[tokens])))
        mean = (total[np.minimum(behind, len(tokens))] - total[:-1]) / wide
        mean[outside] = -np.inf
        best = np.maximum.reduceat(mean, at[:-1])
        hit = np.flatnonzero(mean == best[ids])
        first = hit[np.searchsorted(ids[hit], np.arange(len(docs)))]
        places = first[:, None] + np.minimum(offset, width[:, None] - 1)
        real = (offset < width[:, None]) & (best > 0)[:, None]
        words = tokens[places]
        # average of the window's words, each the average of its subwords
        flat, who = words[real], np.nonzero(real)[0]
        n = size[flat]
        rows = local[np.repeat(head[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        per = np.repeat(1 / (n * width[who]), n)
        text_of = np.repeat(who, n)
        average = np.stack([np.bincount(text_of, per * table[rows, d], len(docs)) for d in range(WIDTH)], axis=1)
        z = average @ weight + bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * share[:, None] * len(y)
        shares = np.stack([np.bincount(rows, per * g[text_of, k], len(own)) for k in (0, 1)], axis=1)
        # of the loss summed over texts for the table, whose rows few texts hold, and of its mean for the softmax
        for x, grad, m in zip((table, weight, bias), (shares @ weight.T + SHRINK * table, average.T @ g / len(y), g.mean(axis=0)), moments, strict=True):
            m[0][...] = 0.9 * m[0] + 0.1 * grad
            m[1][...] = 0.99 * m[1] + 0.01 * grad * grad
            x -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    bucket = np.zeros(BUCKETS)
    bucket[own] = table @ (weight[:, 1] - weight[:, 0])
    return Model(bucket.astype(np.float32).astype(np.float64), float(bias[1] - bias[0]))


def held_out(every: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % every == 0


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model of labels(doc_id, toxic): up to SAMPLE_DOCS documents of each class, the first by a hash of their id among those that
    are ``usable`` (a condition on doc_id) and whose text has SAMPLE_CHARS characters at most, whole. A document is toxic if any of
    its labels says 1; labels other than 0 and 1, and null ones, don't count. Rows that share an id all take part, up to twice SAMPLE_DOCS
    rows in all. Without usable rows of both classes the score is that of the only class, 0 if there is none."""
    classes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    classes = classes.where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lot = F.xxhash64("doc_id", F.lit(3))
    # of both classes twice as many ids as are needed: bounded, so they can be sent to all tasks that read texts
    picked = classes.where("toxic = 1").orderBy(lot).limit(2 * SAMPLE_DOCS).unionByName(classes.where("toxic = 0").orderBy(lot).limit(2 * SAMPLE_DOCS))
    texts = with_columns(docs, doc_id="long", text="string").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")
    sample: list[str] = []
    toxic: list[int] = []
    for k in (0, 1):
        sample += [r.text for r in texts.where(F.col("toxic") == k).orderBy(lot, F.xxhash64("text")).limit(SAMPLE_DOCS).select("text").collect()]
        toxic += [k] * (len(sample) - len(toxic))
    return train(sample, np.array(toxic, np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1 of the most toxic window), predicted (1 if score >= 0.5, else 0).

    Whole texts count. Null and empty texts and those without a word have the score of the model's bias, the least there is; each row
    has its own result, also with a null or repeated doc_id; an empty table gives no rows; other columns are ignored. Of a long
    text a worker holds the text and a number for each word; a word longer than PIECE characters counts in parts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in frames:
            score = sent.value.scores([t if isinstance(t, str) else None for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return map_documents(with_columns(docs, doc_id="long", text="string"), run, "doc_id long, score double, predicted int")
