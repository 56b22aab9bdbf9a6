"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _tables
from .common import Scratch, map_documents, with_columns

#: Bins a packer keeps open at once.
OPEN_BINS = 512
#: Unfilled bins of the first round that one task of the second packs together.
BINS_A_TASK = 20_000


class BestFit:
    """At most ``room`` open bins, in a bitset keyed by free space; an item goes where it leaves least free.

    If none fits and all bins are open, the fullest closes first."""

    def __init__(self, capacity: int, room: int = OPEN_BINS, first: int = 0):
        self.capacity, self.room, self.next, self.open = capacity, room, first, 0
        self.bits, self.by_free = 0, {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return b

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of an item of 1 to capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            free = self.capacity
            if size < free:
                if self.open == self.room:
                    self._take((self.bits & -self.bits).bit_length() - 1)
                    self.open -= 1
                self.open += 1
            b, self.next = self.next, self.next + 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.bits |= 1 << left
        elif free < self.capacity:
            self.open -= 1
        return b, self.capacity - free


def best_fit_pack(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of ``capacity`` and a rest.
    Round one packs each partition's pieces as they come, with no shuffle; round two packs the bins that it left
    unfilled, as items, and moves them whole. A null or empty text is the end id alone. Repeated rows are packed each;
    other columns are ignored; an empty table gives no rows."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, packer = _tables(path), BestFit(capacity, OPEN_BINS, TaskContext.get().partitionId() << 36)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = table.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), *packer.add(len(own) // 4)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place"])

    docs = with_columns(documents, doc_id="long", text="string")
    placed = scratch.keep(map_documents(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"), "placed")
    loose = scratch.keep(placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity), "loose")
    tasks = 1 + loose.count() // BINS_A_TASK

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, names = BestFit(capacity, OPEN_BINS), {}
        for pdf in batches:
            rows = []
            # the largest of a batch first: small bins then fill what those leave
            for b, fill in sorted(zip(pdf["bin"], pdf["fill"], strict=True), key=lambda x: (-x[1], x[0])):
                to, at = packer.add(fill)
                rows.append((b, names.setdefault(to, b), at))
            yield pd.DataFrame(rows, columns=["bin", "sequence_id", "shift"])

    moved = scratch.keep(loose.repartition(tasks, "bin").mapInPandas(merge, "bin long, sequence_id long, shift long"), "moved")
    out = placed.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
