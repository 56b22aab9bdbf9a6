"""Quality rules: base counts, and robust multivariate outliers of transformed statistics.

For each language and source (and each language, for sources with few documents) a minimum-covariance-determinant
estimate is made over all its documents: of the subsets that hold SHARE of them, the one whose covariance has the smallest
determinant. Three deterministic starts (median and quartile ranges; the covariances of the hyperbolic tangents and of the
spatial signs of the standardised statistics) take concentration steps: the documents nearest to an estimate make
the next one. The start with the smallest determinant goes on until its determinant falls no more. A document is
rejected by its Mahalanobis distance. Quantiles and moments are mergeable aggregates, so no group gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, map_documents, pieces, windows, with_struct, word_hashes

#: Share of the documents that an estimate rests on; steps that all starts take, and most steps of the best one.
SHARE, STEPS, MOST_STEPS = 0.75, 2, 12
#: Documents that an estimate needs at least: ten for each statistic.
LEAST = 60
#: Chance of a Gaussian document to lie beyond the cut-off; plain documents have longer tails, so it is small.
TAIL = 1e-6
#: Average words (of five letters, three in a hundred of them capitals) that a document's ratios are smoothed with: those of a
#: short text scatter more, and would make outliers of plain ones.
PRIOR = 50
#: Groups of which a table is small enough for the driver and a broadcast: some 300 bytes for each start, so 18 MB.
FEW = 20_000
_X = [f"x{i}" for i in range(6)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
#: First bytes of characters that are in words.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False


def text_counts(texts: Iterable[str | None], window: int = 8) -> list[tuple[int, int, int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper of each text."""
    texts, out = list(texts), []
    for _, run in pieces(texts):
        w = word_hashes(run, lower=False)
        total = lambda mask, w=w: np.add.reduceat(mask[: w.byte_at[-1]], w.byte_at[:-1], dtype=np.int64).tolist()
        chars, symbols, upper = total(_WORD[w.buf]), total(_SYMBOL[w.buf]), total(_UPPER[w.buf])
        wins = windows(w.h, window)
        for i, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
            repeats = 0
            if b - a > window:
                own = wins[a : b - window + 1]
                s = np.sort(own)
                twice = s[1:][s[1:] == s[:-1]]
                if len(twice):
                    hit = np.isin(own, twice)
                    step = np.zeros(b - a + 1, np.int64)
                    at = np.flatnonzero(hit)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    repeats = int((np.cumsum(step)[:-1] > 0).sum())
            lines = [x for x in run[i].split(b"\n") if x and not x.isspace()] if b > a else []
            out.append((b - a, chars[i], symbols[i], len(lines) - len(set(lines)), repeats, len(lines), upper[i]))
    return out


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame(text_counts(pdf["text"]), columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"])
        for c in ("source", "lang", "doc_id"):
            out.insert(0, c, pdf[c].array)
        yield out


def _chi2(x: float, k: int) -> float:
    """Chi-square distribution for even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, k) < p else (lo, mid)
    return lo


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _state_schema(by: list[str], p: int) -> str:
    floats = ["det", *(f"f{i}" for i in range(p)), *(f"m{i}" for i in range(p)), *(f"p{i}_{j}" for i, j in _pairs(p))]
    return ", ".join([*(f"{c} string" for c in by), "start int", "n long", *(f"{c} double" for c in floats)])


def _state(rows: pd.DataFrame, by: list[str], start: object, floors: np.ndarray, means: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Means and precisions by group and start; a spread counts as the statistic's floor at least."""
    p = means.shape[1]
    cov = cov.copy()
    at = np.arange(p)
    cov[:, at, at] = np.maximum(cov[:, at, at], np.maximum(floors, 1e-9) ** 2)
    inv = np.linalg.inv(cov) if len(cov) else cov
    out = {c: rows[c].array for c in [*by, "n"]} | {"start": start, "det": np.linalg.slogdet(cov)[1]}
    out |= {f"f{i}": floors[:, i] for i in range(p)} | {f"m{i}": means[:, i] for i in range(p)}
    return pd.DataFrame(out | {f"p{i}_{j}": inv[:, i, j] * (1 if i == j else 2) for i, j in _pairs(p)})


def _matrix(pdf: pd.DataFrame, name: str, p: int) -> np.ndarray:
    out = np.zeros((len(pdf), p, p))
    for i, j in _pairs(p):
        out[:, i, j] = out[:, j, i] = pdf[f"{name}{i}_{j}"].to_numpy(float)
    return out


def _starts(by: list[str], p: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means, scale, floors = (pdf[[f"{k}{i}" for i in range(p)]].to_numpy(float) for k in ("m", "s", "f"))
            size = scale[:, :, None] * scale[:, None, :]
            for start, shape in enumerate((np.eye(p)[None].repeat(len(pdf), 0), _matrix(pdf, "t", p), _matrix(pdf, "u", p))):
                # only the order of distances counts, so a little is added that makes every shape invertible
                yield _state(pdf, by, start, floors, means, (shape + 0.01 * np.eye(p)) * size)

    return run


def _from_moments(by: list[str], p: int):
    factor = SHARE / _chi2(_quantile(SHARE, p), p + 2)  # makes the estimate right for Gaussian data

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf["kept_n"].to_numpy(float)[:, None]
            means, floors = pdf[[f"s{i}" for i in range(p)]].to_numpy(float) / m, pdf[[f"f{i}" for i in range(p)]].to_numpy(float)
            cov = _matrix(pdf, "s", p) / m[:, :, None] - means[:, :, None] * means[:, None, :]
            yield _state(pdf, by, pdf["start"].array, floors, means, cov * factor)

    return run


#: Steps of a statistic, of a count's octave and of a distance's octave that order statistics are taken in: so few different values that
#: they are exact, and the same however rows lie in partitions.
X_STEPS, COUNT_STEPS, D_STEPS = 4096, 256, 1024
#: Sums are of whole multiples of 1 / PARTS in decimals: exact, so in any order the same.
PARTS = 1 << 30


def _sum(v: Column) -> Column:
    return F.sum((v * PARTS).cast("decimal(20,0)")).cast("double") / PARTS


def _distance(xs: list[str]) -> Column:
    terms = [F.col(f"p{i}_{j}") * (F.col(xs[i]) - F.col(f"m{i}")) * (F.col(xs[j]) - F.col(f"m{j}")) for i, j in _pairs(len(xs))]
    return sum(terms[1:], terms[0])


def least_determinant(points: DataFrame, by: list[str], xs: list[str], floors: list[Column], scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Rows of _state_schema: the minimum-covariance-determinant estimate of each group of points(by, xs) with ``least`` rows.

    ``floors`` are aggregates: the least spread of each statistic in a group. Groups and statistics have no nulls. Quantiles are those
    of values in small steps and sums are exact, so the estimate depends on the rows only, not on how they lie in
    partitions or in which order tasks end."""
    p, pairs = len(xs), _pairs(len(xs))
    start = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(F.floor(F.col(x) * X_STEPS), [0.25, 0.5, 0.75]).alias(f"q{i}") for i, x in enumerate(xs)), *(f.cast("double").alias(f"f{i}") for i, f in enumerate(floors))).where(F.col("n") >= least)
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * X_STEPS), F.col(f"f{i}"), F.lit(1e-9)).alias(f"s{i}") for i in range(p)]
    start = scratch.keep(start.select(*by, "n", *(((F.col(f"q{i}")[1] + 0.5) / X_STEPS).alias(f"m{i}") for i in range(p)), *scale, *(f"f{i}" for i in range(p))), "quartiles")
    few = start.count() <= FEW
    small = F.broadcast if few else lambda df: df
    z = points.join(small(start), by).select(*by, *(((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, x in enumerate(xs)))
    z = z.withColumn("zz", F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2), F.lit(1e-12)))
    mean = lambda v: _sum(v) / F.count("*")
    shapes = [mean(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in pairs] + [mean(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"u{i}_{j}") for i, j in pairs]
    schema = _state_schema(by, p)
    state = scratch.small(z.groupBy(*by).agg(*shapes).join(small(start), by).mapInPandas(_starts(by, p), schema), "state-0", few)
    sums = [_sum(F.col(xs[i])).alias(f"s{i}") for i in range(p)] + [_sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i, j in pairs]
    kept = [F.first(c).alias(c) for c in ("n", *(f"f{i}" for i in range(p)))]

    def step(state: DataFrame) -> DataFrame:
        near = points.join(small(state), by).select(*by, "start", "n", *(f"f{i}" for i in range(p)), *xs, F.floor(F.log2(F.greatest(_distance(xs), F.lit(1e-12))) * D_STEPS).alias("d"))
        cut = scratch.small(near.groupBy(*by, "start").agg(F.percentile("d", SHARE).alias("cut")), "cut", few)
        moments = near.join(small(cut), [*by, "start"]).where("d <= cut").groupBy(*by, "start").agg(*kept, F.count("*").alias("kept_n"), *sums)
        return moments.mapInPandas(_from_moments(by, p), schema)

    def best(*states: DataFrame) -> DataFrame:
        each = states[0] if len(states) == 1 else states[0].unionByName(states[1])
        names = [c for c in each.columns if c not in by]
        return each.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("r")).select(*by, "r.*")

    for k in range(1, STEPS + 1):
        state = scratch.small(step(state), f"state-{k}", few)
    state = scratch.small(best(state), "best", few)
    for k in range(MOST_STEPS):
        new = scratch.small(best(state, step(state)), f"best-{k}", few)
        if few:  # both are in the driver
            old = {tuple(r[:-1]): r.det for r in state.select(*by, "det").collect()}
            fell = max((old[tuple(r[:-1])] - r.det for r in new.select(*by, "det").collect()), default=None)
        else:
            old = state.select(*by, F.col("det").alias("was"))
            fell = new.join(old, by).agg(F.max(F.col("was") - F.col("det"))).first()[0]
        state = new
        if fell is None or fell < 1e-3:
            break
    return state


def _angle(share: Column) -> Column:
    """A share so transformed that its sampling error is the same at all sizes."""
    return F.asin(F.sqrt(F.least(share, F.lit(1.0))))


def _floors() -> list[Column]:
    """Half the step that one more line, symbol or repeated window makes in a statistic, in a document of its group's median size."""
    median = lambda c: F.pow(F.lit(2.0), F.percentile(F.floor(F.log2(F.greatest(c, F.lit(1))) * COUNT_STEPS), 0.5) / COUNT_STEPS)
    w, ch, ln = (median(c) for c in ("n_words", "word_chars", "n_lines"))
    steps = [1 / w, 1 / ch, F.log1p(100 / ch), _angle(1 / ln), _angle(16 / w), _angle(1 / ch)]
    return [x / 2 for x in steps]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_KINDS = ", ".join(f"{c} long" for c in _COUNTS)


def _statistics(rows: DataFrame, *others: str) -> DataFrame:
    """rows(lang, source, counts) with the names of their groups, the base rules' verdict and the transformed statistics."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    w, ch, ln = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR * 5, F.greatest(F.col("n_lines"), F.lit(1))
    own = F.greatest(F.col("n_words"), F.lit(1))
    x = [F.log(own), F.log(ch / w), F.log1p(100 * F.col("n_symbols") / ch), _angle(F.col("n_dup_lines") / ln), _angle(F.col("n_repeat_words") / own), _angle((F.col("n_upper") + PRIOR * 0.15) / ch)]
    return rows.select(*others, *_COUNTS[:6], named("lang").alias("lang_k"), named("source").alias("own_source"), base.alias("base_failed"), *(e.cast("double").alias(n) for n, e in zip(_X, x, strict=True)))


def _estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Means and precisions of each language and source, and of each language (source '*')."""
    level = F.explode(F.array(F.col("own_source"), F.lit("*"))).alias("source_k")
    points = rows.where("not base_failed").select("lang_k", level, "n_words", "word_chars", "n_lines", *_X)
    state = least_determinant(points, ["lang_k", "source_k"], _X, _floors(), scratch)
    return state.drop("start", "n", "det", *(f"f{i}" for i in range(len(_X))))


def _judged(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with distance (null without an estimate) and kept."""
    small = F.broadcast if state.count() <= FEW else lambda df: df
    limit, inner = _quantile(1 - TAIL, len(_X)), state.drop("lang_k", "source_k").columns
    own = rows.join(small(state.withColumnRenamed("source_k", "own_source")), ["lang_k", "own_source"], "left").withColumn("near", _distance(_X)).drop(*inner)
    wide = own.join(small(state.where("source_k = '*'").drop("source_k")), "lang_k", "left").withColumn("wider", _distance(_X))
    out = wide.withColumn("distance", F.coalesce("near", "wider"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit))


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (null without an estimate).

    documents(doc_id, text, lang, source). Null text has no words and fails the base. Null lang or source is a group of
    its own. Without LEAST documents that pass the base in its source a document is held against its language's
    estimate; without them there, only the base rules hold. Repeated rows stay. An empty table gives no rows."""
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = map_documents(docs, _counts, f"doc_id long, lang string, source string, {_KINDS}")
    rows = scratch.keep(_statistics(counted, "doc_id"), "counts")
    out = _judged(rows, _estimates(rows, scratch))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that quality_verdicts keeps, all columns of theirs.

    Texts are counted once for the estimates and once more as they are judged, so that no text is shuffled; each row has its
    own verdict, whatever its doc_id."""
    scratch = Scratch(documents.sparkSession)
    lang, source = (F.col(f"`{c}`").cast("string").alias(c) for c in ("lang", "source"))
    docs = documents.select(F.lit(None).cast("long").alias("doc_id"), lang, source, "text")
    rows = _statistics(map_documents(docs, _counts, f"doc_id long, lang string, source string, {_KINDS}"))
    state = _estimates(scratch.keep(rows, "counts"), scratch)
    name = free_name(documents, "__c")
    counted = with_struct(documents, text_counts, name, _KINDS.replace(" long", ": bigint"))
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__d")
    return _judged(_statistics(counted.select(whole, lang, source, f"{name}.*"), "__d"), state).where("kept").select("__d.*")
