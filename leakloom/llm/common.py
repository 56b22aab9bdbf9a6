"""Shared plumbing: scratch tables in the cluster's shared folder, documents through Python in bounded parts, and
vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text hashed at once in a Python worker; a longer text is a piece of its own.
PIECE_BYTES = 1 << 21
#: Bytes of an Arrow batch that become one pandas frame in a worker; a longer row is a frame of its own.
FRAME_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="leakloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables that cut lineage: written once to the shared folder, so a lost executor costs no recomputation.

    ``keep`` writes and rereads a DataFrame, and Spark deletes the write's shuffle files when it is over; ``small`` carries
    a table of a checked number of rows through the driver instead of files; ``drop`` deletes tables that no later step
    reads. What is left goes when the driver ends, as lazy results may still read it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/leakloom-{uuid.uuid4().hex}", 0
        path, fs = self._fs()
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path, schema, before = f"{self.root}/{self.n}-{name}", df.schema, self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def small(self, df: DataFrame, name: str, few: bool) -> DataFrame:
        """df, cut off from its lineage: as rows of the driver if its caller knows them to be ``few``, else as keep does."""
        return self.spark.createDataFrame(df.collect(), df.schema) if few else self.keep(df, name)

    def drop(self, *names: str) -> None:
        path, fs = self._fs()
        for s in fs.listStatus(path):
            if s.getPath().getName().split("-", 1)[1] in names:
                fs.delete(s.getPath(), True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of FRAME_BYTES for the session, where it has the default of 64 MB: both sides hold a batch several times over."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH, f"{FRAME_BYTES}b")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; a missing one is an error, clashing extra columns don't matter."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df hasn't got, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Memory that a worker has freed goes back to the system, so that idle workers don't keep what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of about FRAME_BYTES of text each."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // FRAME_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def with_struct(docs: DataFrame, compute: Callable[[list], list[tuple]], name: str, fields: str) -> DataFrame:
    """docs, all columns as they are, and column ``name``: a struct of ``fields`` that compute gives for each text (a string
    column). Rows go through Python whole, so nothing has to be joined back and each text is computed once."""
    small_batches(docs.sparkSession)
    at, added = next(i for i, c in enumerate(docs.columns) if c.lower() == "text"), StructType.fromDDL(f"`{name}` struct<{fields}>")
    carried = to_arrow_schema(added)
    keys = [f.name for f in added[0].dataType.fields]

    def arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = [dict(zip(keys, x, strict=True)) for x in compute(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, carried.field(0).type)], schema=pa.schema([*part.schema, carried.field(0)]))
            give_back()

    return docs.mapInArrow(arrow, StructType([*docs.schema.fields, *added.fields]))


def map_documents(docs: DataFrame, run: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` over pandas frames of docs(doc_id, ...) of bounded size; ids travel as strings, as pandas would round long
    integers beside nulls."""
    small_batches(docs.sparkSession)
    carried = to_arrow_schema(StructType.fromDDL(schema.replace("doc_id long", "doc_id string")))

    def arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in slices(batch):
                    yield part.to_pandas()
                give_back()

        for out in run(parts()):
            yield from pa.Table.from_pandas(out[carried.names], schema=carried, preserve_index=False).to_batches()

    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(arrow, schema.replace("doc_id long", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long")) if "doc_id" in out.columns else out


_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Key of all word hashes.
_SEED = np.uint64(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    s = np.uint64(33)
    h = (h ^ (h >> s)) * _M1
    h = (h ^ (h >> s)) * _M2
    return h ^ (h >> s)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` consecutive words; fewer words make one window of all of them."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        out = out * _P + hashes[k : n - w + 1 + k]
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed side by side with other words'; the rest of a longer word is hashed on its own.
_SIDE = 64


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of runs of about PIECE_BYTES; null is empty."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > PIECE_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


class Hashed(NamedTuple):
    """Words of a run of texts: hashes, first and last-plus-one byte, each text's first word (and the end), each text's
    first byte (and the end), bytes, and the eight bytes from each place on."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    byte_at: np.ndarray
    buf: np.ndarray
    eight: np.ndarray

    def gram(self, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
        """Hash of the n <= 8 bytes from each place on."""
        return mix((self.eight[at] & _FIRST_BYTES[n]) ^ np.uint64(salt * int(_P) & (1 << 64) - 1))


def word_hashes(run: list[bytes], lower: bool = True, space: np.ndarray = _SPACE) -> Hashed:
    """Words are maximal runs of bytes that are not ``space`` (0x20, 0x09-0x0D; the byte between texts always is)."""
    raw = b"\n".join([*run, b"\n" * 8])
    raw = raw.lower() if lower else raw
    buf = np.frombuffer(raw, np.uint8)
    gap = space[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    turn = turn if gap[0] else np.concatenate(([0], turn))
    start, end = turn[::2], turn[1::2]
    at = np.cumsum([0, *(len(b) + 1 for b in run)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    size = end - start
    # eight bytes at a time, each mixed in before the next
    h = mix((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _P + _SEED))
    for k in range(8, _SIDE, 8):
        who = np.flatnonzero(size > k)
        if not len(who):
            break
        h[who] = mix(h[who] * _P + (eight[start[who] + k] & _FIRST_BYTES[np.minimum(size[who] - k, 8)]))
    for i in np.flatnonzero(size > _SIDE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] + _SIDE : end[i]], int(h[i]))
    return Hashed(h, start, end, np.searchsorted(start, at), at, buf, eight)
