"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M at least every vector's norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0): their squared distance
is |a|^2 + M^2 - 2 a.x, so the largest inner product is the nearest row and a window of scores is an annulus of distances. Rows are
dealt into blocks of a bounded size, each a tree of its own, built once and stored as one row; anchors travel in packs to
all trees. A search goes through a tree nearest first: a heap holds nodes by the best score that the triangle inequality
leaves them and rows by their score; nodes outside the annulus or without a label wanted are never opened, and it ends after
k rows. The k best of all trees are the anchor's. Scores are integers, exact; distances only steer.

Every anchor meets every tree: with every 100th row an anchor, n rows of d components send n / 100 vectors to n * d / 2^19 trees.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Components of a tree's vectors, and of a pack of anchors, about; rows of a leaf.
TREE, PACK, LEAF = 1 << 19, 1 << 14, 512
#: Relative slack of distances, far above their rounding.
SLACK = 1e-9
_NODE = ["start", "end", "left", "right", "near", "far", "least", "most"]


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, bound: float) -> dict[str, np.ndarray]:
    """The tree as arrays. A node's rows are start .. end - 1; an inner node's first is its vantage point, and the others are
    halved by their distance from it; near and far bound the distances of a node's rows from its parent's vantage point, least and most its labels."""
    ids, labels, x = ids.copy(), labels.copy(), x.copy()
    y = np.column_stack([x, np.sqrt(np.maximum(bound - (x.astype(np.float64) ** 2).sum(axis=1), 0))])
    nodes: list[list[float]] = []
    todo = [(0, len(ids), -1, 0, 0.0, np.inf)]
    while todo:
        a, b, parent, side, near, far = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        me = len(nodes)
        nodes.append([a, b, -1, -1, near, far, labels[a:b].min(initial=np.iinfo(np.int64).max), labels[a:b].max(initial=np.iinfo(np.int64).min)])
        if b - a <= LEAF:  # in order of ids, so that ties are
            by = a + np.argsort(ids[a:b], kind="stable")
            for z in (ids, labels, x):
                z[a:b] = z[by]
            continue
        # the row farthest from the first is on the rim, where distances spread most
        v = a + int(((y[a:b] - y[a]) ** 2).sum(axis=1).argmax())
        d = np.sqrt(((y[a:b] - y[v]) ** 2).sum(axis=1))
        d[v - a] = -1
        by = a + np.argsort(d, kind="stable")
        for z in (ids, labels, x, y):
            z[a:b] = z[by]
        d, half = d[by - a], (b - a) // 2 + 1
        todo.append((a + 1, a + half, me, 0, d[1], d[half - 1]))
        todo.append((a + half, b, me, 1, d[half], d[-1]))
    return {"ids": ids, "labels": labels, "x": x} | {k: np.array([n[i] for n in nodes], np.float64 if k in ("near", "far") else np.int64) for i, k in enumerate(_NODE)}


class Anchor:
    """One anchor in one tree; what it has seen of opened leaves is kept for its other searches."""

    def __init__(self, tree: dict, a: np.ndarray, label: int, own: int, bound: float):
        self.t, self.a, self.label, self.own = tree, a, label, own
        self.base, self.seen = float((a.astype(np.float64) ** 2).sum() + bound), {}
        # exact scores of all vantage points at once
        self.spans = (tree["x"][tree["points"]] @ a).astype(np.int64).tolist()

    def leaf(self, k: int, i: int, j: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(- score, id) of the rows i .. j - 1 whose label is (same) or isn't the anchor's, best first, ties to smaller ids."""
        if (k, same) not in self.seen:
            ids, labels, x = self.t["ids"][i:j], self.t["labels"][i:j], self.t["x"][i:j]
            at = (labels == self.label if same else labels != self.label).nonzero()[0]
            if same:
                mine = at[ids[at] == self.own]
                at = at[~np.isin(at, mine[(x[mine] == self.a).all(axis=1)])] if len(mine) else at
            minus = (x[at] if same else x) @ -self.a
            minus = minus if same else minus[at]
            by = minus.argsort(kind="stable")  # a leaf's rows are in order of their ids
            self.seen[k, same] = minus[by], ids[at[by]]
        return self.seen[k, same]

    def distance(self, score: float) -> float:
        return math.sqrt(max(self.base - 2 * score, 0.0))

    def nearest_first(self, same: bool, low: int | None = None, high: int | None = None) -> Iterator[tuple[int, int]]:
        """(score, id) of the rows whose label is (same) or isn't the anchor's and whose score is in low .. high (None: open), best
        first, ties to smaller ids. The anchor's own row (id, label and vector) is left out."""
        t = self.t
        inner = 0.0 if high is None else self.distance(high) * (1 - SLACK)
        outer = math.inf if low is None else self.distance(low) * (1 + SLACK)
        # (- best score, 0, node, 0) or (- score, 1, id, (leaf, place in it)): a leaf shows its next row only
        heap: list[tuple] = []

        def rows(k: int, i: int, j: int) -> None:
            minus, _ = self.leaf(k, i, j, same)
            show(k, 0 if high is None else int(minus.searchsorted(-high)))

        def show(k: int, at: int) -> None:
            minus, ids = self.seen[k, same]
            if at < len(minus) and (low is None or -minus[at] >= low):
                heapq.heappush(heap, (int(minus[at]), 1, int(ids[at]), (k, at)))

        def node(k: int, nearest: float) -> None:
            least, most = t["least"][k], t["most"][k]
            none = not least <= self.label <= most if same else least == most == self.label
            if not none and nearest <= outer:
                best = (self.base - max(nearest, inner) ** 2) / 2
                heapq.heappush(heap, (-(best + SLACK * (abs(best) + self.base)), 0, k, ()))

        if t["end"][0]:
            node(0, 0.0)
        while heap:
            score, kind, k, at = heapq.heappop(heap)
            if kind:
                yield -score, k
                show(at[0], at[1] + 1)
            elif t["left"][k] < 0:
                rows(k, t["start"][k], t["end"][k])
            else:
                rows(k, t["start"][k], t["start"][k] + 1)
                d = self.distance(self.spans[t["point"][k]])
                for child in (t["left"][k], t["right"][k]):
                    far = t["far"][child]
                    slack = SLACK * (d + far + 1)
                    if d + far + slack >= inner:
                        node(child, max(0.0, t["near"][child] - d, d - far) - slack)


def opened(blob: bytes) -> dict:
    """A stored tree, its nodes as lists, with the rows of its vantage points and each inner node's place among these."""
    with np.load(io.BytesIO(blob)) as z:
        tree = {k: z[k].tolist() if k in _NODE else z[k] for k in z.files}
    inner = [k for k, left in enumerate(tree["left"]) if left >= 0]
    places = {k: n for n, k in enumerate(inner)}
    return tree | {"points": np.array([tree["start"][k] for k in inner], np.int64), "point": [places.get(k, -1) for k in range(len(tree["left"]))]}


def first(n: int, rows: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    return [r for _, r in zip(range(n), rows)]


def rows_of(embeddings: DataFrame, label: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole numbers floor(scale * x)), dim, key: the rows that take part, repeated ones once."""
    good = F.expr("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(good)
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long"))).withColumn("dim", F.size("v"))
    return whole.withColumn("key", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["vec_id", "label", "v"])


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, all long but rank.

    Anchors are rows whose vec_id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows of its label
    (all, if fewer); for each the first k (all, if fewer) rows of other labels come with low * positive_score <= 100 * negative_score <=
    high * positive_score. First is larger score, ties smaller vec_id; ``label`` is the SQL expression of the label. Components count as floor(256 * x).
    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part. Rows equal in vec_id, label and
    whole vector count once; others that share a vec_id are rows of their own, as anchors and as candidates. Only vectors of one
    length are compared. An anchor without positives, and a positive without negatives, gives no rows; so does an empty table. A
    negative positive_score has an empty window, 0 the window 0. Scores must fit into a long: larger vectors are an error. Other columns are ignored."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    rows = scratch.keep(rows_of(embeddings, label), "rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size, picked, top = rows.agg(F.coalesce(F.sum(F.greatest("dim", F.lit(1))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, F.greatest("dim", F.lit(1)))), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if top >= 2**62:
        raise ValueError("inner products of these vectors don't fit into a long")
    bound, kind = top * (1 + SLACK), np.float64 if top < 2**52 else np.int64  # sums below 2^53 are exact in doubles
    blocks, packs = -(-size // TREE), -(-picked // PACK)
    trees = scratch.keep(_trees(rows, max(blocks, 1), bound, kind), "trees")
    spread = F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("pack", F.pmod("key", F.lit(max(packs, 1))))

    def searched(queries: DataFrame, search: Callable[[Anchor, dict], list[tuple]], schema: str) -> DataFrame:
        """search of every query(dim, pack, q struct) in every tree of its length; q.v is the anchor's vector."""
        packed = queries.groupBy("dim", "pack").agg(F.collect_list("q").alias("qs")).withColumn("block", spread)
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, qs in zip(batch.column("tree"), batch.column("qs"), strict=True):
                    tree = opened(blob.as_py())
                    out = [r for q in qs.as_py() for r in search(Anchor(tree, np.array(q["v"], tree["x"].dtype), q["label"], q["vec_id"], bound), q)]
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

        # Spark takes the packs for as many bytes as before they are repeated for each tree, and would send all through the driver
        return trees.join(packed.hint("merge"), ["dim", "block"]).select("tree", "qs").mapInArrow(run, schema)

    def best(found: DataFrame, by: list[str], score: str, name: str, n: int) -> DataFrame:
        """The first n of each anchor; Spark cuts each partition's rows to n before the shuffle."""
        return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), name))).where(F.col("rank") <= n)

    near = searched(
        anchors.select("dim", "pack", F.struct("vec_id", "label", "key", "v").alias("q")),
        lambda a, q: [(q["vec_id"], q["key"], s, i) for s, i in first(positives, a.nearest_first(True))],
        "vec_id long, key long, positive_score long, positive_id long",
    )
    near = scratch.keep(best(near, ["vec_id", "key"], "positive_score", "positive_id", positives), "positives")
    windows = near.groupBy("vec_id", "key").agg(F.collect_list(F.struct("rank", "positive_id", "positive_score")).alias("ps"))

    def negatives(a: Anchor, q: dict) -> list[tuple]:
        out = []
        for p in q["ps"]:
            s = p["positive_score"]
            lo, hi = -(-low * s // 100), high * s // 100
            if lo <= hi:
                out += [(q["vec_id"], q["key"], p["rank"], p["positive_id"], s, t, i) for t, i in first(k, a.nearest_first(False, lo, hi))]
        return out

    found = searched(
        anchors.join(windows.hint("merge"), ["vec_id", "key"]).select("dim", "pack", F.struct("vec_id", "label", "key", "v", "ps").alias("q")),
        negatives,
        "anchor_id long, key long, place long, positive_id long, positive_score long, negative_score long, negative_id long",
    )
    return best(found, ["anchor_id", "key", "place"], "negative_score", "negative_id", k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _trees(rows: DataFrame, blocks: int, bound: float, kind: type) -> DataFrame:
    """dim, block, tree: one row a tree."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "key"])
        x = np.array(pdf["v"].tolist(), kind).reshape(len(pdf), key[0])
        out = io.BytesIO()
        np.savez(out, **build(pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), x, bound))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "tree": [out.getvalue()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.select("dim", "block", "vec_id", "label", "key", "v").groupBy("dim", "block").applyInPandas(one, "dim int, block int, tree binary")
