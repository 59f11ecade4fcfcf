"""A store on files that changes at once or not at all.

Each table is a set of folders of Parquet files.  A manifest, one small file a
version, names the folders of all tables.  A commit writes new folders first
and then puts the next manifest in place by a rename; what has no manifest was
never written.  A writer that is lost, or that finds its version taken, leaves
the store as it was, and running it again does the rest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.lineage import settle
from tidemark.operators import upsert
from tidemark.schemas import KEYS, TABLES

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class Store:
    """Tables under ``root``, a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] = TABLES):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path(MANIFESTS)
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of: ``tables``, the folders of each, and ``marks``, how far each source has come."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "marks": {}}
        return json.loads(self.spark.read.text(f"{self.root}/{MANIFESTS}/{version:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest one by default; readers of a version are never disturbed."""
        kind = StructType.fromDDL(self.tables[name])
        folders = self.manifest(version)["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in folders])

    def commit(self, added: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame | None] | None = None, mark: tuple[str, int] | None = None, base: int | None = None) -> int:
        """The new version: rows added to tables and tables replaced (by nothing: None), all at once.

        ``mark`` (source, step) says how far a source has come; a step that is
        not beyond the source's mark was committed before and changes nothing.
        ``base`` is the version that the rows were worked out from; if another
        writer has gone beyond it, the commit is refused.
        """
        now = self.manifest(base)
        if mark and now["marks"].get(mark[0], -1) >= mark[1]:
            return now["version"]
        tables = dict(now["tables"])
        for name, rows in (replaced or {}).items():
            tables[name] = [] if rows is None else self._stage(name, rows)
        for name, rows in (added or {}).items():
            tables[name] = [*tables.get(name, []), *self._stage(name, rows)]
        marks = now["marks"] | ({mark[0]: mark[1]} if mark else {})
        version = now["version"] + 1
        self._publish({"version": version, "tables": tables, "marks": marks})
        return version

    def _stage(self, name: str, rows: DataFrame) -> list[str]:
        kind = StructType.fromDDL(self.tables[name])
        there = set(rows.columns)
        columns = [(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.select(*columns).write.mode("error").parquet(f"{self.root}/{folder}")
        return [folder]

    def _publish(self, manifest: dict) -> None:
        target = self._path(MANIFESTS, f"{manifest['version']:012d}.json")
        draft = self._path(MANIFESTS, f".{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is taken")

    # ---- the store's own writes

    def insert(self, name: str, rows: DataFrame, arrival: list[str], mark: tuple[str, int] | None = None) -> int:
        """Rows whose natural key the table lacks, numbered on; the first by ``arrival`` of each key.  Repeating it adds nothing."""
        base = self.version()
        target = self.read(name, base)
        there = set(rows.columns)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in target.schema if f.name not in there and f.name != "id"}
        fresh = settle(upsert.insert_new(target, rows.withColumns(missing), KEYS[name], arrival))
        if fresh.isEmpty() and mark is None:
            return base
        return self.commit(added={name: fresh}, mark=mark, base=base)

    def merge_entities(self, rows: DataFrame) -> int:
        """Entities with the attributes of ``rows`` over their own, and new ones."""
        base = self.version()
        return self.commit(replaced={"entities": settle(upsert.merge_entities(self.read("entities", base), rows))}, base=base)

    def replace(self, name: str, rows: DataFrame | None) -> int:
        """A table made anew, as a sweep does with contradictions; None clears it."""
        return self.commit(replaced={name: rows}, base=self.version())

    def supersede(self, claims: DataFrame, base: int) -> int:
        """Claims in the state that :func:`temporal.supersede` gives, worked out from version ``base``."""
        return self.commit(replaced={"claims": settle(claims)}, base=base)

    def unnamed(self) -> list[str]:
        """Folders that the newest version does not name: those of older versions, and what lost writers left."""
        named = {f for folders in self.manifest()["tables"].values() for f in folders}
        found = []
        for name in self.tables:
            if self._files.exists(self._path(name)):
                found += [f"{name}/{s.getPath().getName()}" for s in self._files.listStatus(self._path(name))]
        return sorted(set(found) - named)
