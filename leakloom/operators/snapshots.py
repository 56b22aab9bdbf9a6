"""Several tables that change together: files are written first, then one manifest publishes them all.

A snapshot is a manifest, a small JSON file that lists the folders of each table, the schemas, and the last batch of each source. A load
writes new folders, which no reader sees, and then the next manifest under a name that can be taken only once: readers have the
earlier state or the later one, never a mix, whatever step a load dies at. A batch whose number its source has published already is a
replay and does nothing. Manifests and folders never change, so a reader keeps its snapshot while others publish."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders that an appended table has before it is written anew as one: what a manifest lists stays short.
MOST_FOLDERS = 64


class Conflict(Exception):
    """Another load has published since this one began; it should run again on the new snapshot."""


class Store:
    """Tables under ``root``, a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last published one; 0: none yet."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "batches": {}, "tables": {}}
        path, fs = self._path(f"manifests/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, all of the same version."""
        return {name: self._read(t) for name, t in self.manifest(version)["tables"].items()}

    def _read(self, table: dict) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in table["folders"]))

    def publish(self, source: str, batch: int, load: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], append: Mapping[str, DataFrame] | None = None) -> int:
        """The version after batch ``batch`` of ``source``; batches of a source have growing numbers.

        ``load`` gets the present tables and gives those to replace; ``append`` holds rows to add to tables. All are written, then published
        at once. Raises Conflict if another load was faster: nothing is published then, and the call can be repeated."""
        now = self.manifest()
        if now["batches"].get(source, -1) >= batch:
            return now["version"]
        new = {"version": now["version"] + 1, "batches": {**now["batches"], source: batch}, "tables": dict(now["tables"])}
        for name, df in load({n: self._read(t) for n, t in now["tables"].items()}).items():
            new["tables"][name] = {"folders": [self._written(name, df)], "schema": df.schema.jsonValue()}
        for name, df in (append or {}).items():
            old = new["tables"].get(name, {"folders": [], "schema": df.schema.jsonValue()})
            rows = df.select(*StructType.fromJson(old["schema"]).names)
            if len(old["folders"]) >= MOST_FOLDERS:
                old, rows = {**old, "folders": []}, self._read(old).unionByName(rows)
            new["tables"][name] = {**old, "folders": [*old["folders"], self._written(name, rows)]}
        self._put(new)
        return new["version"]

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def _put(self, manifest: dict) -> None:
        """Writes a manifest beside its place and moves it there; the move fails if the place is taken."""
        jvm = self.spark._jvm
        draft, fs = self._path(f"manifests/.{uuid.uuid4().hex}.draft")
        place, _ = self._path(f"manifests/{manifest['version']:012d}.json")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(place):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is published already")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, place, none)  # without the option to overwrite
        except Exception as e:
            if fs.exists(draft):
                fs.delete(draft, False)
            if fs.exists(place):
                raise Conflict(f"version {manifest['version']} is published already") from e
            raise

    def forget(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep``, and folders that none of these lists: earlier states, and what loads that died have left. Not
        while a load runs: its folders aren't listed yet."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {f for v in kept for t in self.manifest(v)["tables"].values() for f in t["folders"]}
        gone = []
        path, fs = self._path("data")
        for table in fs.listStatus(path) if fs.exists(path) else []:
            for s in fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{s.getPath().getName()}"
                if name not in used:
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        path, fs = self._path("manifests")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            stem = s.getPath().getName().removesuffix(".json")
            if not stem.isdigit() or int(stem) not in kept:
                fs.delete(s.getPath(), False)
        return gone
