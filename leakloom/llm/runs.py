"""Periodic runs of words, by a harmonic grid of longest common extensions.

For each period p the grid points 0, p, 2p, ... are queried in pairs of neighbours: how far do the words from jp and from
(j+1)p on agree, forwards (suffix array, range minimum over its common prefixes) and backwards (the same of the reversed
words)? Both extents and p make a maximal stretch of period p. A run of length >= max(LEAST, TIMES * p) agrees with itself,
moved by p, on a stretch that holds a grid point and the ``reach(p)`` words from there on, so a pair that differs at
one of a few such words is answered without a look-up: no run is lost. Grids have n ln n pairs, all handled in arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_documents, with_columns

#: Words of a run at least, and periods in it at least.
LEAST, TIMES = 24, 3
#: Pairs of grid points held at once; words of texts whose arrays are built together.
PAIRS, TOGETHER = 1 << 20, 1 << 18
#: Words compared before a pair is looked up; entries of a block of the range minimum.
PROBES, BLOCK = 4, 16


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, each suffix's place, common prefix of each suffix with the one before) by doubling: only
    suffixes that still share their rank are sorted again."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], ids[sa[1:]] != ids[sa[:-1]])))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1  # beyond the end
    rank[sa] = np.repeat(heads, np.diff(np.append(heads, n))).astype(np.int32)
    levels, width = [], 1
    many = np.diff(np.append(heads, n))
    open_ = np.flatnonzero(np.repeat(many > 1, many))  # places whose suffix isn't alone
    while len(open_):
        levels.append(rank.copy())
        who = sa[open_]
        key = rank[who].astype(np.int64) * (n + 2) + rank[np.minimum(who + width, n)] + 1
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        sa[open_] = who
        head = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(head)
        many = np.diff(np.append(first, len(key)))
        rank[who] = np.repeat(open_[first], many).astype(np.int32)
        open_, width = open_[np.repeat(many > 1, many)], width * 2
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):  # the longest power of two at which both agree, then the next
        same = levels[k][a] == levels[k][b]
        step = same * (1 << k)
        common[1:] += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return sa, rank[:n], common


class Extension:
    """Longest common extension of two places: the least common prefix between their suffixes' places."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        _, self.place, self.common = suffixes(ids)
        full = -(-self.n // BLOCK) * BLOCK
        padded = np.full(full, np.iinfo(np.int32).max, np.int32)
        padded[: self.n] = self.common
        self.tables = [padded.reshape(-1, BLOCK).min(axis=1)]
        width = 1
        while 2 * width <= len(self.tables[0]):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-width], t[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For i != k, both in 0..n; nothing extends from n."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (k < self.n))
        x, y = self.place[i[inside]].astype(np.int64), self.place[k[inside]].astype(np.int64)
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1  # lo <= place < hi
        best = np.full(len(inside), np.iinfo(np.int32).max, np.int64)
        left, right = -(-lo // BLOCK), hi // BLOCK  # whole blocks
        for t in range(BLOCK):
            for at, ok in ((lo + t, lo + t < np.minimum(left * BLOCK, hi)), (hi - 1 - t, hi - 1 - t >= np.maximum(right * BLOCK, lo))):
                best[ok] = np.minimum(best[ok], self.common[at[ok]])
        whole = right > left
        level = np.zeros(len(inside), np.int64)
        level[whole] = np.frexp((right - left)[whole].astype(np.float64))[1] - 1
        for v in np.unique(level[whole]).tolist():
            w = np.flatnonzero(whole & (level == v))
            t = self.tables[v]
            best[w] = np.minimum(best[w], np.minimum(t[left[w]], t[right[w] - (1 << v)]))
        out[inside] = best
        return out


def reach(p: np.ndarray, least: int, times: int) -> np.ndarray:
    """Words that agree from the first grid point in a run's stretch on, at least."""
    return np.maximum(least - p, (times - 1) * p) - p + 1


def grid(ids: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(place, period) of the pairs of grid points that agree at all probed words; at: each text's first place, and the end."""
    size = np.diff(at)
    docs = np.flatnonzero(size >= max(least, times))
    longest = size[docs] // times
    total = np.cumsum(longest)
    for a in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        flat = np.arange(a, min(a + PAIRS, int(total[-1])))
        d = np.searchsorted(total, flat, "right")
        p = flat - (total[d] - longest[d]) + 1
        pairs = np.maximum((size[docs[d]] - reach(p, least, times)) // p, 0)  # the last probed word of the second point is inside
        upto = np.cumsum(pairs)
        for b in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            # rows of (text, period) whose pairs lie in b : b + PAIRS
            r0, r1 = np.searchsorted(upto, b, "right"), np.searchsorted(upto, min(b + PAIRS, int(upto[-1])) - 1, "right") + 1
            begin = upto[r0:r1] - pairs[r0:r1]
            first, last = np.maximum(begin, b), np.minimum(upto[r0:r1], b + PAIRS)
            n = last - first
            row = np.repeat(np.arange(r1 - r0), n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first - begin, n)
            q = p[r0:r1][row]
            x = at[docs[d[r0:r1]]][row] + j * q
            same = ids[x] == ids[x + q]
            x, q = x[same], q[same]
            for t in range(1, PROBES):
                o = (reach(q, least, times) - 1) * t // (PROBES - 1)
                same = ids[x + o] == ids[x + q + o]
                x, q = x[same], q[same]
            yield x, q


def runs_of(ids: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order; ids of different texts differ."""
    found = list(grid(ids, at, least, times))
    x = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
    q = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
    if not len(x):
        return np.empty((0, 4), np.int64)
    # arrays only of texts that have something to look up
    doc = np.searchsorted(at, x, "right") - 1
    used = np.unique(doc)
    part = np.concatenate([ids[at[d] : at[d + 1]] for d in used.tolist()])
    first = np.concatenate(([0], np.cumsum((at[used + 1] - at[used])[:-1])))
    shift = at[used] - first
    x = x - shift[np.searchsorted(used, doc)]
    forward, back, n = Extension(part), Extension(part[::-1].copy()), len(part)
    out = []
    for a in range(0, len(x), PAIRS):
        i, p = x[a : a + PAIRS], q[a : a + PAIRS]
        before = back(n - i, n - i - p)
        start, length = i - before, before + p + forward(i, i + p)
        ok = length >= np.maximum(least, times * p)
        out.append(np.unique(np.stack([start, length, p], axis=1)[ok], axis=0))
    r = np.unique(np.concatenate(out), axis=0)
    # one stretch found by several periods has the least
    r = r[np.concatenate(([True], (r[1:, :2] != r[:-1, :2]).any(axis=1)))] if len(r) else r
    k = np.searchsorted(first, r[:, 0], "right") - 1
    rows = np.column_stack([used[k], r[:, 0] - first[k], r[:, 1], r[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words those that stay: no run holds them after its first period."""
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turn[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed (the words that stay, joined by a space).

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, compared exactly. A run is a maximal stretch with least
    period p and at least max(least, times * p) words; its words after the first period go. Null and empty texts have no
    words and no runs; each row has a result of its own, also with a null or repeated doc_id; an empty table gives no rows; other
    columns are ignored. A text is one object in a worker, and its arrays take about 4 bytes a word for each doubling of
    its longest repetition; only texts with a pair to look up have such arrays. ``times`` is 2 at least."""
    if least < 1 or times < 2:
        raise ValueError("least must be positive and times 2 at least")

    def group(texts: list[list[bytes]]) -> tuple[list[list[tuple]], list[bytes]]:
        at = np.concatenate(([0], np.cumsum([len(w) for w in texts])))
        ids, seen = np.empty(int(at[-1]), np.int64), 0
        for k, words in enumerate(texts):
            names: dict[bytes, int] = {}
            ids[at[k] : at[k + 1]] = [names.setdefault(w, len(names)) for w in words]
            ids[at[k] : at[k + 1]] += seen
            seen += len(names)
        found = runs_of(ids, at, least, times)
        cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        spans, stay = [], []
        for k, words in enumerate(texts):
            own = found[cut[k] : cut[k + 1], 1:]
            spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
            if len(own):
                words = [words[i] for i in np.flatnonzero(collapsed(len(words), own)).tolist()]
            stay.append(b" ".join(words))
        return spans, stay

    def run(frames):
        for pdf in frames:
            # texts of about TOGETHER words at a time
            words, spans, stay, counts, size = [], [], [], [], 0
            for t in [*pdf["text"], None]:
                words.append([] if t is None else t.encode("utf-8", "surrogatepass").split())
                counts.append(len(words[-1]))
                size += counts[-1]
                if size >= TOGETHER or len(counts) > len(pdf):
                    s, k = group(words)
                    spans, stay, words, size = spans + s, stay + k, [], 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": counts[:-1], "runs": spans[:-1], "collapsed": [b.decode("utf-8", "surrogatepass") for b in stay[:-1]]})

    out = with_columns(docs, doc_id="long", text="string")
    return map_documents(out, run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats put into the texts of a tenth of them, in place of their own ends: with h the CRC-32 of the decimal doc_id
    and g = h / 10, in texts with h % 10 = 0 each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) / (3 + g % 8). Other texts, null ones and those without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = F.expr(
        r"""transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
        transform(array(named_struct('g', cast(floor(crc32(cast(doc_id as string)) / 10) as long), 'n', cast(size(w) as long))), s ->
        transform(array(s.g % greatest(s.n, 1L)), a ->
        transform(array(1L + (s.n - a) div (3L + s.g % 8L)), p ->
        array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' '))[0])[0])[0])[0]"""
    )
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), planted).otherwise(F.col("text")))


def digests(runs: DataFrame) -> DataFrame:
    """periodic_runs as numbers: the run with the most periods (exactly; ties to the first start, then period) and digests of the lists."""
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
