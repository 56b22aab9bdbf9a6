"""N-gram Jaccard join by count vectors.

Every distinct shingle is hashed into one of GROUPS groups; a document's group counts are a point. The
summed coordinate minima of two points bound their sets' overlap from above, so an R-tree over points
(each node keeps its coordinate maxima and its smallest set) finds all pairs that may reach the
similarity; their shingle sets are then compared exactly.

At the similarities asked for, the ball around a point is a seventh of its mass, which prunes little over
one tree of a whole corpus: tree nodes of different documents of like size overlap, and the search is
quadratic. The points are therefore dealt into cells first, without losing a pair: two sets that reach
the similarity share a shingle among the rarest quarter of each (any one global order is right; ours is
by a fixed-size count sketch over the whole corpus, then by hash), and each shared rare shingle is a cell.

1. equal sets become one class, named by 128 bits of hash; 2. one shuffle brings each rare shingle's classes together, and
those that share one are gathered under the first of them (most pairs share one gathering only); gatherings are dealt into
blocks of bounded size, and an R-tree over each block finds the members that have a partner the bound allows;
3. these members' texts are brought to their block and all its pairs are compared exactly at once, by a product of
0/1 matrices over the shingles that both sides hold. A pair counts in the least of the gatherings that both members
share, so every link comes out just once, also inside components. No cap drops a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_documents, pieces, windows, with_columns, word_hashes
from .components import components

#: Coordinates of a count vector.
GROUPS = 128
#: Counters of the sketch that orders shingles by rarity: 4 MB, or 16 MB from SKETCH_STEP bytes of input on. At 100 TB a counter
#: holds millions of shingles; those that stand out of its noise, from some thousand copies on, still come last.
SKETCH_BITS, SKETCH_STEP = (20, 22), 1 << 34
SKETCH_BLOCK = 1 << 14
#: Most members, and about the most shingles, of one block of a gathering.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Columns of one product of 0/1 matrices.
COLUMNS = 4096
#: Gatherings of several blocks, and bytes of candidate members, that are broadcast at most.
FEW, FEW_BYTES = 100_000, 16 << 20
LEAF = 16
#: Parts that a component's classes are dealt into when they look up its least id.
SALTS = 64


def shingle_sets(texts: Sequence[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct ``width``-word shingles, A-Z lower-cased; none without words."""
    for _, run in pieces(texts):
        words = word_hashes(run)
        h, at = words.h, words.at
        all_windows = windows(h, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            t = np.sort(all_windows[a : b - width + 1] if b - a >= width else windows(h[a:b], width))
            yield t[np.concatenate(([True], t[1:] != t[:-1]))] if len(t) else t


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """A set's name: both halves of a 128-bit hash, as signed 64-bit integers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(tokens.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def count_vector(tokens: np.ndarray, groups: int = GROUPS) -> bytes:
    v = np.bincount((tokens & np.uint64(0xFFFFFF)).astype(np.int64) % groups, minlength=groups)
    return v.astype("<u2" if v.max() < 65536 else "<u4").tobytes()


def read_vectors(packed: list[bytes], groups: int = GROUPS) -> np.ndarray:
    if all(len(b) == 2 * groups for b in packed):
        return np.frombuffer(b"".join(packed), "<u2").reshape(-1, groups).astype(np.int32)
    return np.stack([np.frombuffer(b, "<u2" if len(b) == 2 * groups else "<u4").astype(np.int32) for b in packed])


def need(a, b, num: int, den: int):
    """Least overlap of sets of a and b shingles with overlap / union >= num / den."""
    return -(-num * (a + b) // (num + den))


class CountVectorRTree:
    """Bulk-loaded R-tree: points sorted by set size, then by their heaviest group; nodes of LEAF entries keep coordinate maxima and least set size."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort((vectors.argmax(axis=1), sizes))
        self.levels = [(sizes[self.order], vectors[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            s, v = self.levels[-1]
            at = np.arange(0, len(s), LEAF)
            self.levels.append((np.minimum.reduceat(s, at), np.maximum.reduceat(v, at, axis=0)))

    def search(self, size: int, vector: np.ndarray, num: int, den: int) -> np.ndarray:
        """Positions of all points whose bound reaches what the similarity needs."""
        s, v = self.levels[-1]
        live = np.arange(len(s))
        for level in range(len(self.levels) - 1, -1, -1):
            s, v = self.levels[level]
            live = live[np.minimum(v[live], vector).sum(axis=1) >= need(size, s[live], num, den)]
            if level and len(live):
                live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
                live = live[live < len(self.levels[level - 1][0])]
        return self.order[live]


def _signatures(width: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for pdf in batches:
            rows = []
            for doc_id, row, t in zip(pdf["doc_id"], pdf["row_key"], shingle_sets(pdf["text"], width), strict=True):
                rows.append((doc_id, row, len(t), *(set_key(t) if len(t) else (None, None)), count_vector(t) if len(t) else None, 0))
                np.add.at(sketch, (t >> shift).astype(np.int64), np.uint32(1))
            doc_ids, row_keys, n, key, more, vec, kind = zip(*rows, strict=True)
            # a null beside them would round plain integers
            yield pd.DataFrame({"doc_id": doc_ids, "row_key": row_keys, "n": n, "key": pd.array(key, "Int64"), "more": pd.array(more, "Int64"), "vec": vec, "kind": kind})
        if sketch.any():
            # counts within one task are small; saturation can only change the order of cells, never the result
            blocks = np.minimum(sketch, 65535).astype("<u2").reshape(-1, SKETCH_BLOCK)
            yield pd.DataFrame({"doc_id": [str(i) for i in range(len(blocks))], "row_key": 0, "n": 0, "key": 0, "more": 0, "vec": [b.tobytes() for b in blocks], "kind": 1})

    return run


def _merge_sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, vec in zip(pdf["doc_id"], pdf["vec"], strict=True):
            v = np.frombuffer(vec, "<u2").astype(np.uint32)
            sums[block] = sums[block] + v if block in sums else v
    if sums:
        yield pd.DataFrame({"block": list(sums), "counts": [v.tobytes() for v in sums.values()]})


def _prefixes(width: int, num: int, den: int, sketch, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, counts, done = np.uint64(64 - bits), sketch.value, set()
        for pdf in batches:
            tokens, keys = [], []
            for t in shingle_sets(pdf["text"], width):
                n = len(t)
                if n == 0 or (key := set_key(t)) in done:  # a task names a set once, however many copies it has
                    continue
                done.add(key)
                p = n - -(-num * n // den) + 1
                order = np.lexsort((t, counts[(t >> shift).astype(np.int64)]))[:p]
                tokens.append(t[order])
                keys.append(np.full(p, key[0], np.int64))
            if tokens:
                yield pd.DataFrame({"doc_id": None, "token": np.concatenate(tokens).view(np.int64), "key": np.concatenate(keys)})

    return run


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (token, key): each key beside the first key of its token, and the first beside itself; tokens
    of a single key give nothing. Only the last token is held from one batch to the next."""
    token = first = None
    for pdf in batches:
        t, k = pdf["token"].to_numpy(), pdf["key"].to_numpy()
        new = np.concatenate(([t[0] != token], t[1:] != t[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
        lo = np.where(at < 0, first if first is not None else 0, k[at])
        later = lo != k
        got = np.unique(np.concatenate([np.stack([lo[later], k[later]], axis=1), np.stack([lo[later], lo[later]], axis=1)]), axis=0)
        token, first = t[-1], lo[-1]
        yield pd.DataFrame({"first": got[:, 0], "key": got[:, 1]})


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (arrays without repeats)."""
    out = np.zeros((len(left), len(right)), np.int64)
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    if not len(owner):
        return out
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    ours = owner < len(left)
    common = (np.bincount(at[ours], minlength=len(values)) > 0) & (np.bincount(at[~ours], minlength=len(values)) > 0)
    column = (np.cumsum(common) - 1)[at]
    live = np.flatnonzero(common[at])
    live = live[np.argsort(column[live], kind="stable")]
    column, owner = column[live], owner[live]
    for c in range(0, int(common.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[part], column[part] - c] = 1
        out += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def _block_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole blocks of rows sorted by (first, i, j): frames, and where each block in them begins (and the end)."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        cell = held[["first", "i", "j"]].to_numpy()
        cut = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        if len(cut):
            yield held.iloc[: cut[-1]], np.array([0, *cut])
            held = held.iloc[cut[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _sides(i: int, j: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _uncovered(before: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Pairs of the block that count here: no earlier gathering holds both members."""
    new = overlaps([before[x] for x in left], [before[x] for x in right]) == 0
    return np.triu(new, 1) if same else new


def _block_members(num: int, den: int):
    """The members of blocks that have a partner which the bound allows."""

    def wanted(size, own, vec, before, i: int, j: int) -> np.ndarray:
        left, right = _sides(i, j, own)
        if not len(left) or not len(right):
            return left[:0]
        tree, near = CountVectorRTree(size[right], vec[right]), np.zeros((len(left), len(right)), bool)
        for k, x in enumerate(left):
            near[k, tree.search(int(size[x]), vec[x], num, den)] = True
        if near.any():
            near &= _uncovered(before, left, right, i == j)
        return np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _block_groups(batches):
            length, keep = np.diff(cuts), []
            two = cuts[:-1][length == 2]  # most blocks: two members, bounded at once
            if len(two):
                g = pdf.iloc[two], pdf.iloc[two + 1]
                best = np.minimum(*(read_vectors(x["vec"].tolist()) for x in g)).sum(axis=1)
                ok = best >= need(g[0]["n"].to_numpy(), g[1]["n"].to_numpy(), num, den)
                split = (g[0]["i"] == g[0]["j"]).to_numpy() | (g[0]["own"].to_numpy() != g[1]["own"].to_numpy())
                for k, x, y in zip(two[ok & split].tolist(), g[0]["before"][ok & split], g[1]["before"][ok & split], strict=True):
                    if not len(x) or not len(y) or not len(np.intersect1d(x, y)):
                        keep += [k, k + 1]
            for b in np.flatnonzero(length > 2).tolist():
                g = pdf.iloc[cuts[b] : cuts[b + 1]]
                keep += (cuts[b] + wanted(g["n"].to_numpy(), g["own"].to_numpy(), read_vectors(g["vec"].tolist()), g["before"].tolist(), g["i"].iat[0], g["j"].iat[0])).tolist()
            yield pdf.iloc[keep][["first", "i", "j", "own", "key", "more", "row_key", "before"]]

    return run


def _forest_of(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which links (left x right) a spanning forest of the block needs."""
    tree, free_l, free_r = np.zeros_like(links), links.any(axis=1), links.any(axis=0)
    same = len(left) == len(right) and bool((left == right).all())
    while free_l.any():
        x = int(free_l.argmax())
        free_l[x], todo = False, [(0, x)]
        if same:
            free_r[x] = False
        while todo:
            side, x = todo.pop()
            for s in (0, 1) if same else (side,):
                got = np.flatnonzero(links[x] & free_r) if s == 0 else np.flatnonzero(links[:, x] & free_l)
                if s == 0:
                    tree[x, got], free_r[got] = True, False
                else:
                    tree[got, x], free_l[got] = True, False
                if same:
                    free_l[got] = free_r[got] = False
                todo += [(1 - s, y) for y in got.tolist()]
    return tree


def class_name(key: int, more: int) -> str:
    return f"{key + (1 << 63):016x}{more + (1 << 63):016x}"


def _block_links(width: int, num: int, den: int, pairs: bool):
    """All links of blocks, of whole texts, as classes a and b, and n: with ``pairs`` each link and its overlap; else the number of each member's links (a = b) and the links of a spanning forest (n = 0), in proportion to
    the members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _block_groups(batches):
            keys, more, owns, firsts, seconds, before, texts = (pdf[c].to_numpy() for c in ("key", "more", "own", "i", "j", "before", "text"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = list(shingle_sets(texts[a:b], width))
                # rows whose keys meet may bring other texts than the class has, and repeated rows bring its text again
                good, seen = [], set()
                for k, t in enumerate(sets):
                    if len(t) and (key := (int(keys[a + k]), int(more[a + k]))) not in seen and set_key(t) == key:
                        seen.add(key)
                        good.append(k)
                own, sets = owns[a:b][good], [sets[k] for k in good]
                left, right = _sides(firsts[a], seconds[a], own)
                if not len(left) or not len(right):
                    continue
                both = overlaps([sets[x] for x in left], [sets[x] for x in right])
                size = np.array([len(t) for t in sets])
                links = den * both >= num * (size[left][:, None] + size[right] - both)
                if links.any():
                    links &= _uncovered([before[a + k] for k in good], left, right, firsts[a] == seconds[a])
                if not links.any():
                    continue
                name = np.array([class_name(int(keys[a + k]), int(more[a + k])) for k in good], object)
                x, y = np.nonzero(links if pairs else _forest_of(links, left, right))
                yield pd.DataFrame({"a": name[left[x]], "b": name[right[y]], "n": both[x, y] if pairs else 0})
                if not pairs:
                    who, many = np.concatenate([left, right]), np.concatenate([links.sum(axis=1), links.sum(axis=0)])
                    who, many = who[many > 0], many[many > 0]
                    yield pd.DataFrame({"a": name[who], "b": name[who], "n": many})

    return run


def _classes_and_links(documents: DataFrame, width: int, num: int, den: int, scratch: Scratch, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, row_key, n, key, more) of every row, classes (key, more, node, n), and what _block_links says of them. A class's node
    is its least doc_id, null if all its rows have none; its text is that of the row with its least row_key."""
    spark = documents.sparkSession
    docs = with_columns(documents, doc_id="long", text="string")
    docs = docs.withColumn("row_key", row_key())
    bits = SKETCH_BITS[int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SKETCH_STEP]
    made = scratch.keep(map_documents(docs, _signatures(width, bits), "doc_id long, row_key long, n long, key long, more long, vec binary, kind int"), "made")
    signed = made.where("kind = 0").drop("kind")
    merged = made.where("kind = 1").select("doc_id", "vec").repartition(16, "doc_id").mapInPandas(_merge_sketch, "block long, counts binary").collect()
    counts = np.zeros(1 << bits, np.uint32)
    for r in merged:
        counts[r.block * SKETCH_BLOCK :][:SKETCH_BLOCK] = np.frombuffer(r.counts, np.uint32)
    sketch = spark.sparkContext.broadcast(counts)
    classes = scratch.keep(signed.where("key is not null").groupBy("key", "more").agg(F.min("doc_id").alias("node"), F.min("row_key").alias("row_key"), F.max("n").alias("n"), F.max("vec").alias("vec")), "classes")

    # cells, rare shingles that two classes share, gathered under their first member; 64 bits of a class's name do here, as
    # two classes that share them only bring candidates
    rows = map_documents(docs.select("doc_id", "text"), _prefixes(width, num, den, sketch, bits), "doc_id string, token long, key long").select("token", "key")
    near = scratch.keep(rows.repartition("token").sortWithinPartitions("token", "key").mapInPandas(_gathered, "first long, key long").distinct(), "near")

    # blocks of gatherings; a row is in one block with each block of its gathering
    member = near.join(classes.select("key", "n"), "key")
    most = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    large = scratch.keep(member.groupBy("first").agg(most.alias("blocks")).where("blocks > 1"), "large")
    large = F.broadcast(large) if large.count() <= FEW else large
    dealt = near.join(large, "first", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    known = near.groupBy("key").agg(F.collect_list("first").alias("firsts"))  # at most one for each rare shingle of the text
    dealt = dealt.join(known, "key").withColumn("before", F.filter("firsts", lambda f: f < F.col("first"))).join(classes, "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key", "more", "first"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("first", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "more", "row_key", "n", "vec", "before")
    dealt = dealt.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j")
    found = scratch.keep(dealt.mapInPandas(_block_members(num, den), "first long, i int, j int, own int, key long, more long, row_key long, before array<long>"), "found")
    scratch.drop("near")

    # exact comparison; whole texts travel: they are shorter than their hashes. Few members go to the texts where these lie,
    # so that each text moves once only, to its block
    size = found.agg(F.sum(F.size("before") * 8 + 100)).first()[0] or 0
    whole = docs.select("row_key", "text").join(F.broadcast(found) if size <= FEW_BYTES else found, "row_key")
    whole = whole.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j")
    links = scratch.keep(whole.mapInPandas(_block_links(width, num, den, pairs), "a string, b string, n long"), "links")
    scratch.drop("found", "large")
    return signed.select("doc_id", "row_key", "n", "key", "more"), classes.select("key", "more", "node", "n"), links


def row_key() -> Column:
    """A hash of doc_id and text: with doc_id it tells rows apart whose ids are null or shared; equal rows have one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))  # corpus_pipeline names its rows by the same


def _name() -> Column:
    """class_name in Spark."""
    half = lambda c: F.lpad(F.lower(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    return F.concat(half("key"), half("more"))


def ngram_jaccard_join(documents: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the join of all rows with each other.

    members: doc_id, n_shingles, class_key of every row; rows with equal shingle sets have one class, a row without
    shingles has none. links: class_a, class_b, doc_a, doc_b, n_a, n_b, overlap, each pair of different classes with
    den * overlap >= num * |union| once, inside components too; doc_a and doc_b are the classes' least doc_ids, null
    where all rows of a class have none."""
    rows, classes, links = _classes_and_links(documents, width, num, den, Scratch(documents.sparkSession), pairs=True)
    a, b = (classes.select(_name().alias(f"class_{x}"), F.col("node").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.col("n").alias("overlap")).join(a, "class_a").join(b, "class_b")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), _name().alias("class_key")), pairs.select("class_a", "class_b", "doc_a", "doc_b", "n_a", "n_b", "overlap")


def ngram_jaccard_members(documents: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, n_links, component_id (least doc_id reachable over links) and component
    (the component's name, that of its least class; null without shingles).

    Documents link when den * |overlap| >= num * |union| of their shingle sets; n_links counts the links of a document's
    class with other classes (ngram_jaccard_join lists them; equal sets are one class and don't count).
    A null or wordless text has no shingles and links with nothing. Rows with a null doc_id take part as all others do, and a
    component of such rows only has a null component_id. Repeated rows stay; rows that share a doc_id but not a text are documents
    of their own, told apart by row_key. An empty table gives an empty result. Other columns are ignored."""
    scratch = Scratch(documents.sparkSession)
    signed, classes, links = _classes_and_links(documents, width, num, den, scratch, pairs=False)
    comps = components(links.where("a <> b").select("a", "b"), scratch, "c").select(F.col("node").alias("a"), F.col("comp").alias("component"))
    many = links.where("a = b").groupBy("a").agg(F.sum("n").alias("n_links"))
    named = classes.select("key", "more", "node", _name().alias("a"))
    # classes with links look up their component's least id, in SALTS parts, as one component may hold most of them
    linked = comps.join(named.select("a", "node"), "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("component").agg(F.min("node").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.join(least, ["component", "salt"]).select("a", "component", "component_id")
    named = named.join(many, "a", "left").join(linked, "a", "left")
    own = F.when(F.col("component").isNull(), F.col("node")).otherwise(F.col("component_id"))
    named = named.select("key", "more", "n_links", own.alias("component_id"), F.coalesce("component", "a").alias("component"))
    out = signed.join(named, ["key", "more"], "left")
    id_ = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), id_.alias("component_id"), "component")


def ngram_jaccard_components(documents: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of ngram_jaccard_members."""
    return ngram_jaccard_members(documents, width, num, den).select("doc_id", "n_shingles", "component_id")
