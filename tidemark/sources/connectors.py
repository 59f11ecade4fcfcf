"""Connectors as a data source: files of a folder tree through readers that are plugged in by name.

``register(spark)`` makes ``spark.read.format("tidemark").load(root)`` known:
one row (source_uri, source_type, content) a document, as
:func:`tidemark.sources.files.discover` gives them, so that
:func:`~tidemark.sources.files.documents`, ``images`` and ``segments`` go on from
there.  A reader of one's own is a :class:`Connector` more.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.commits import Store
from tidemark.lineage import few, settle
from tidemark.operators import upsert

from . import files

FORMAT = "tidemark"
PARTITION_BYTES = 64 << 20
ROWS_AT_ONCE = 10_000


def whole_file(stream: io.BufferedIOBase) -> Iterator[tuple[str, bytes]]:
    yield "", stream.read()


def json_lines(name: str, text: str) -> Callable[[io.BufferedIOBase], Iterator[tuple[str, bytes]]]:
    """Reads files of a JSON object a line: a document each, by the fields of its name and its text; a missing text is empty."""

    def read(stream: io.BufferedIOBase) -> Iterator[tuple[str, bytes]]:
        for line in stream:
            if line.strip():
                row = json.loads(line)
                yield str(row[name]), (row.get(text) or "").encode()

    return read


@dataclass(frozen=True)
class Connector:
    """Files of one kind: which paths below the root they have, which documents they hold, how those are cut.

    ``read`` gives (name, content) of each document of an open file, from a
    stream, so that a file of many documents is never whole in memory; a name
    that is not empty follows the path behind a ``#``.
    """

    source_type: str
    pattern: str
    segment: Callable[[str, object], list[tuple[str, bool]]] = files.markdown_segments
    read: Callable[[io.BufferedIOBase], Iterable[tuple[str, bytes]]] = whole_file


STANDARD = [Connector(kind, pattern, files.SEGMENTERS[kind]) for kind, pattern in files.CONNECTORS.items()]


def segmenters(connectors: list[Connector]) -> dict[str, Callable]:
    """What :func:`files.segments` takes."""
    return {c.source_type: c.segment for c in connectors}


def _located(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


class Files(InputPartition):
    """(path, source_type) of files that one task reads."""

    def __init__(self, taken: list[tuple[str, str]]):
        super().__init__(taken)
        self.taken = taken


class FilesReader(DataSourceReader):
    """Paths and sizes are listed where the query is planned, as Spark's own file sources do; tasks open the files.

    Filters are not pushed into the listing: Spark 4.1 keeps what was pushed
    with the frame, so that a union of two filters of one frame would read the
    files of the last one only.  The option ``connectors`` prunes instead.
    """

    def __init__(self, root: str, connectors: dict[str, Connector], wanted: set[str], most: int):
        self.root, self.connectors, self.wanted, self.most = root.rstrip("/"), connectors, wanted, most

    def _taker(self, path: str) -> str | None:
        takers = [k for k, c in self.connectors.items() if re.search(c.pattern, path)]
        if len(takers) > 1:
            raise ValueError(f"more than one connector takes {path}: {', '.join(takers)}")
        return takers[0] if takers else None

    def partitions(self) -> list[Files]:
        system, base = _located(self.root)
        out: list[list[tuple[str, str]]] = [[]]
        size = 0
        listed = system.get_file_info(fs.FileSelector(base, recursive=True))
        for found in sorted((x for x in listed if x.is_file), key=lambda x: x.path):
            path = found.path[len(base) :].lstrip("/")
            kind = None if any(p[:1] in "._" for p in path.split("/")) else self._taker(path)
            if kind in self.wanted:
                if out[-1] and size + found.size > self.most:
                    out.append([])
                    size = 0
                out[-1].append((path, kind))
                size += found.size
        return [Files(taken) for taken in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches by bytes, as Spark's own of 10,000 rows would hold that many documents whole."""
        rows, size = [], 0
        for row in self._documents(partition):
            rows.append(row)
            size += len(row[2])
            if size >= files.BYTES_AT_ONCE or len(rows) >= ROWS_AT_ONCE:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _documents(self, partition: Files) -> Iterator[tuple[str, str, bytes]]:
        system, base = _located(self.root)
        for path, kind in partition.taken:
            with io.BufferedReader(system.open_input_stream(f"{base}/{path}")) as stream:
                for name, content in self.connectors[kind].read(stream):
                    yield f"{path}#{name}" if name else path, kind, content


def _batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    kinds = {"source_uri": pa.string(), "source_type": pa.string(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(own, kind) for own, kind in zip(zip(*rows), kinds.values())], list(kinds))


class FilesSource(DataSource):
    """Options: ``path`` (the root), ``connectors`` (names of those to use, by commas; all by default), ``partitionBytes``."""

    known: dict[str, Connector] = {}

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source_uri string, source_type string, content binary"

    def reader(self, schema) -> FilesReader:
        asked = {x.strip() for x in self.options.get("connectors", ",".join(self.known)).split(",")}
        unknown = sorted(asked - set(self.known))
        if unknown:
            raise ValueError(f"no such connector: {', '.join(unknown)}")
        return FilesReader(self.options["path"], self.known, asked, int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession, connectors: list[Connector] = STANDARD) -> None:
    """Make ``format("tidemark")`` known with these connectors; no two may have one name."""
    known = {c.source_type: c for c in connectors}
    if len(known) < len(connectors):
        raise ValueError("two connectors of one name")
    spark.dataSource.register(type("Known", (FilesSource,), {"known": known}))


def ingest(store: Store, found: DataFrame, connectors: list[Connector] = STANDARD, mark: tuple[str, int] | None = None, caption=None) -> DataFrame:
    """Writes what is new of ``found`` to the store's documents and chunks, both or neither; returns (figure, n) of the run.

    A document is known if its content is: known ones are neither cut nor
    written again, and of equal ones in a run the first by source_uri counts.
    Figures: documents_added, documents_known, chunks_added.  A step that
    ``mark`` has recorded adds nothing.
    """
    base = store.version()
    target = store.read("documents", base).select("id", "source_uri", "content_hash")
    spark = found.sparkSession
    pictures = files.images(found, keep=("content",)).select("source_uri", "source_type", F.lit(None).cast("string").alias("raw_text"), "content_hash", "content")
    held = settle(files.texts(found).withColumn("content", F.lit(None).cast("binary")).unionByName(pictures))
    n = held.count()
    if mark is not None and store.manifest(base)["marks"].get(mark[0], -1) >= mark[1]:
        return spark.createDataFrame([("documents_added", 0), ("documents_known", n), ("chunks_added", 0)], "figure string, n bigint")
    # what is new is told by addresses and hashes; texts are looked at after that
    new = settle(upsert.insert_new(target, held.select("source_uri", "content_hash"), ["content_hash"], ["source_uri"]))
    named = few(new.select("id", F.col("source_uri").alias("_uri"), F.col("content_hash").alias("_hash")))
    own = held.join(named, F.col("source_uri").eqNullSafe(F.col("_uri")) & F.col("content_hash").eqNullSafe(F.col("_hash")))
    told = files.described(own.where(F.col("source_type") != "image"), ("id",)).unionByName(files.images(own, caption, ("id",)))
    fresh = settle(told.withColumn("ingested_at", F.current_timestamp()))
    added = new.count()
    if fresh.count() > added:  # an address that gave one text twice
        fresh = settle(fresh.dropDuplicates(["id"]))
    cut = files.pack(files.segments(fresh.select("id", "source_uri", "source_type", "as_of", "raw_text"), segmenters(connectors)), keep=("id",))
    top = store.read("chunks", base).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    # a range partitioning reads its rows twice, which must not cut the texts twice
    chunks = upsert.number(settle(cut.select(F.col("id").alias("document_id"), "ordinal", "text")), ["document_id", "ordinal"], top)
    pieces = chunks.count()
    if added or mark:
        store.commit(added={"documents": fresh, "chunks": chunks}, mark=mark, base=base)
    figures = [("documents_added", added), ("documents_known", n - added), ("chunks_added", pieces)]
    return spark.createDataFrame(figures, "figure string, n bigint")
