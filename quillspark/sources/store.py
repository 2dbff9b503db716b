"""Tables that change together: numbered commits in a shared folder.

A commit writes its data first, under a name of its own, and becomes visible by
one manifest, ``versions/<number>.json``, that is published only if no other
writer has published that number.  A writer that loses reads the new tables and
merges again, so nothing is lost and the tables of a commit appear together or not
at all; a writer that dies leaves files that no manifest names.

A table is a list of layers, each with rows and with keys whose earlier rows are
gone, so replacing a few rows writes a few rows.  Reading takes the newest drop of
each key (combined before the shuffle); ``compact`` folds the layers into one.

The file system must refuse to rename a file onto another, as HDFS does; on a local
one a hard link does it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Layers of a table beyond which a commit writes it anew.
MAX_LAYERS = 16
EMPTY_LAYER = {"rows": None, "n_rows": 0, "drops": None, "n_drops": 0}


class Conflict(RuntimeError):
    """Too many others were faster."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one commit; ``stamps`` are what it says about itself."""

    version: int = -1
    tables: Mapping[str, dict] = field(default_factory=dict)
    stamps: Mapping[str, Any] = field(default_factory=dict)

    def rows_written(self, table: str) -> int:
        """Rows of the table's newest layer."""
        return self.tables[table]["layers"][-1]["n_rows"]


class TableStore:
    """``keys`` names the tables and the column by which rows of each are replaced (None: only as a whole)."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, str | None]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), dict(keys)
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("versions"))

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # --- reading

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest commit, or that of a number that is still kept."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return Snapshot()
        stream = self._fs.open(self._at("versions", f"{version:012d}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(said["version"], said["tables"], said["stamps"])

    def read(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of a table that has been written."""
        return self._merged(table, (snapshot or self.snapshot()).tables[table])

    def _merged(self, table: str, held: dict) -> DataFrame:
        schema, key = StructType.fromJson(held["schema"]), self.keys[table]
        read = lambda name, kind: self.spark.read.schema(kind).parquet(f"{self.path}/data/{name}")
        rows = [(i, layer) for i, layer in enumerate(held["layers"]) if layer["rows"]]
        drops = [(i, layer["drops"]) for i, layer in enumerate(held["layers"]) if layer["drops"] and i > rows[0][0]]
        if not drops:
            out = [read(layer["rows"], schema) for _, layer in rows]
            return out[0] if len(out) == 1 else _union(out)
        numbered = _union([read(layer["rows"], schema).withColumn("_layer", F.lit(i)) for i, layer in rows])
        kind = StructType([schema[key]])
        gone = _union([read(name, kind).withColumn("_gone", F.lit(i)) for i, name in drops])
        newest = gone.groupBy(F.col(key).alias("_key")).agg(F.max("_gone").alias("_gone"))
        kept = numbered.join(newest, F.col(key).eqNullSafe(F.col("_key")), "left").filter("_gone is null or _layer >= _gone")
        return kept.select(*[F.col(f"`{c}`") for c in schema.names])

    # --- writing

    def update(self, change: Callable[[Commit], None], tries: int = 20) -> Snapshot:
        """Apply ``change`` to the newest tables; where another commit came between, to that one's.

        ``change`` may run several times, so what it does must follow from what it reads.
        """
        for _ in range(tries):
            commit = Commit(self, self.snapshot())
            try:
                change(commit)
                done = self._publish(commit)
            except BaseException:
                commit.discard()
                raise
            if done is not None:
                return done
            commit.discard()
        raise Conflict(f"{tries} commits to {self.path} were overtaken")

    def _publish(self, commit: Commit) -> Snapshot | None:
        version = commit.base.version + 1
        out = Snapshot(version, commit.tables, commit.stamps)
        said = json.dumps({"version": version, "tables": out.tables, "stamps": out.stamps}, default=str)
        draft, final = self._at("versions", f"_{uuid.uuid4().hex}"), self._at("versions", f"{version:012d}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(said.encode())
        finally:
            stream.close()
        won = self._rename(draft, final)
        if not won or self._fs.exists(draft):
            self._fs.delete(draft, False)
        return out if won else None

    def _rename(self, draft, final) -> bool:
        if self._fs.exists(final):
            return False
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, final)
        local = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
        try:
            self._jvm.java.nio.file.Files.createLink(local(final), local(draft))
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    # --- upkeep

    def compact(self, table: str) -> Snapshot:
        """The table's layers as one."""
        return self.update(lambda commit: commit.replace(table, commit.read(table)))

    def expire(self, keep: int = 2) -> list[int]:
        """Drop all but the newest ``keep`` commits, and the data that none of those names.

        Readers of a kept commit are not disturbed, nor is a commit on its way, as
        only data of the dropped commits is looked at.
        """
        versions = self.versions()
        old, kept = versions[: -max(1, keep)], versions[-max(1, keep) :]
        named = lambda v: {layer[k] for t in self.snapshot(v).tables.values() for layer in t["layers"] for k in ("rows", "drops") if layer[k]}
        used = set().union(*map(named, kept)) if kept else set()
        unused = set().union(*map(named, old)) - used if old else set()
        for v in old:
            self._fs.delete(self._at("versions", f"{v:012d}.json"), False)
        for name in sorted(unused):
            self._fs.delete(self._at("data", name), True)
        return old


class Commit:
    """What one commit changes; ``read`` gives the tables as they were before."""

    def __init__(self, store: TableStore, base: Snapshot):
        self.store, self.base = store, base
        self.tables: dict[str, dict] = {k: {"schema": v["schema"], "layers": list(v["layers"])} for k, v in base.tables.items()}
        self.stamps: dict[str, Any] = dict(base.stamps)
        self.written: list[str] = []

    def read(self, table: str) -> DataFrame:
        return self.store.read(table, self.base)

    def after(self, table: str) -> DataFrame:
        """The rows of a table as this commit leaves them so far."""
        return self.store._merged(table, self.tables[table])

    def newest(self, table: str) -> DataFrame:
        """The rows that the table's newest layer adds."""
        held = self.tables[table]
        return self.store._merged(table, held | {"layers": held["layers"][-1:]})

    def exists(self, table: str) -> bool:
        return table in self.base.tables

    def _write(self, df: DataFrame) -> tuple[str, int]:
        name, seen = uuid.uuid4().hex, Observation()
        self.written.append(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{self.store.path}/data/{name}")
        return name, seen.get["n"]

    def replace(self, table: str, df: DataFrame) -> int:
        """The whole table anew; gives the number of rows, counted as they are written."""
        name, n = self._write(df)
        self.tables[table] = {"schema": df.schema.jsonValue(), "layers": [EMPTY_LAYER | {"rows": name, "n_rows": n}]}
        return n

    def change(self, table: str, rows: DataFrame | None = None, drop: DataFrame | None = None) -> tuple[int, int]:
        """Drop the rows of the keys in ``drop`` (a column named as the table's key), then add ``rows``; gives both numbers."""
        key, schema, layer = self.store.keys[table], StructType.fromJson(self.tables[table]["schema"]), dict(EMPTY_LAYER)
        if len(self.tables[table]["layers"]) >= MAX_LAYERS:
            self.replace(table, self.store._merged(table, self.tables[table]))
        if drop is not None:
            layer["drops"], layer["n_drops"] = self._write(drop.select(F.col(key).cast(schema[key].dataType).alias(key)).distinct())
        if rows is not None:
            layer["rows"], layer["n_rows"] = self._write(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]))
        self.tables[table]["layers"].append(layer)
        return layer["n_rows"], layer["n_drops"]

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Rows replace those of their key."""
        n, _ = self.change(table, rows)
        layer = self.tables[table]["layers"][-1]
        # the keys as they were written, so that ``rows`` is computed once
        keys = self.store.spark.read.schema(StructType.fromJson(self.tables[table]["schema"])).parquet(f"{self.store.path}/data/{layer['rows']}")
        layer["drops"], layer["n_drops"] = self._write(keys.select(self.store.keys[table]).distinct())
        return n

    def stamp(self, **values: Any) -> None:
        self.stamps |= values

    def discard(self) -> None:
        for name in self.written:
            self.store._fs.delete(self.store._at("data", name), True)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
