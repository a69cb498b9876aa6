"""Artifacts as a data source: files of runs, written with an all-or-nothing commit, listed in pages by cursor.

``spark.dataSource.register(ArtifactSource)``, then ``format("artifacts")`` with ``path``, a folder of
any file system that pyarrow opens (local, HDFS, S3, GCS).

Writing (rows of path and content): each task attempt puts its files below a folder of its own, and
the commit is one small file that lists the folders of the attempts that succeeded. What a failed
or repeated attempt left is in no list. Reading: the folders of all commits, one partition each; of a
path that several commits hold the newest is told. Paths are relative and stay below the folder.

Options for reading: ``content`` (default true; false lists only), ``before`` (ISO time: only files modified
earlier), ``after`` (cursor: only paths behind it) and ``limit`` (a page of so many paths in order).
"""

from __future__ import annotations

import datetime as dt
import heapq
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, modified timestamp, size long, content binary, version string"
#: Files that a task lists or reads at a time.
PAGE = 1_000


def _store(path: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _name(path: str) -> str:
    """A relative path as the name of a file: one level, whatever the path holds."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "../")) or clean in ("..", "."):
        raise ValueError(f"an artifact's path must stay below its folder: {path}")
    return quote(clean, safe="")


@dataclass
class _Folder(InputPartition):
    folder: str
    version: str


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


def _commits(path: str) -> list[tuple[str, list[str]]]:
    """(version, task folders) of all commits, oldest first. A row per write, a name per task."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    names = sorted(x.base_name for x in found if x.base_name.endswith(".json"))
    return [(n.removesuffix(".json"), json.loads(store.open_input_stream(f"{root}/commits/{n}").read())["folders"]) for n in names]


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], str(options.get("content", "true")).lower() == "true"
        self.after, self.limit = options.get("after", ""), int(options.get("limit", 0))
        before = options.get("before")
        self.before = dt.datetime.fromisoformat(before).replace(tzinfo=dt.UTC) if before else None

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f, version) for version, folders in _commits(self.path) for f in folders] or [_Folder("", "")]

    def read(self, part: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        if not part.folder:
            return
        store, root = _store(self.path)
        files = ((unquote(x.base_name), x) for x in store.get_file_info(fs.FileSelector(f"{root}/{part.folder}", allow_not_found=True)))
        wanted = ((p, x) for p, x in files if p > self.after and (self.before is None or x.mtime < self.before))
        rows = heapq.nsmallest(self.limit, wanted, key=lambda r: r[0]) if self.limit else wanted
        for path, x in rows:
            try:
                content = store.open_input_stream(x.path).read() if self.content else None
            except FileNotFoundError:  # pruned between the listing and the reading
                continue
            yield path, x.mtime, x.size, content, part.version


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        # versions sort by time
        self.version = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        folder, n = f"data/{self.version}/{uuid.uuid4().hex}", 0
        store.create_dir(f"{root}/{folder}", recursive=True)
        for row in rows:
            with store.open_output_stream(f"{root}/{folder}/{_name(row['path'])}") as out:
                out.write(bytes(row["content"] or b""))
            n += 1
        return _Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root = _store(self.path)
        before = [n for n, _ in _commits(self.path)]
        store.create_dir(f"{root}/commits", recursive=True)
        with store.open_output_stream(f"{root}/commits/{self.version}.json") as out:
            out.write(json.dumps({"folders": [m.folder for m in messages if m is not None and m.files]}).encode())
        if self.overwrite:
            for n in before:
                store.delete_file(f"{root}/commits/{n}.json")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        store, root = _store(self.path)
        try:
            store.delete_dir(f"{root}/data/{self.version}")
        except FileNotFoundError:
            pass


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArtifactReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArtifactWriter(self.options, overwrite)


def newest_versions(listed: DataFrame) -> DataFrame:
    """Of each path the row of the last commit."""
    row = F.struct(*listed.columns)
    return listed.groupBy("path").agg(F.max_by(row, "version").alias("row")).select("row.*")


def artifact_page(spark, folder: str, after: str = "", limit: int = PAGE, before: str | None = None) -> DataFrame:
    """(path, modified, size): the page of ``limit`` paths behind the cursor ``after``, in order. The last path is the next cursor."""
    read = spark.read.format("artifacts").option("path", folder).option("content", "false").option("after", after)
    # of a path's versions each folder gives its own, so a page of paths needs a page of every folder
    rows = newest_versions((read.option("before", before) if before else read).option("limit", limit).load())
    return rows.select("path", "modified", "size").orderBy("path").limit(limit)


def fetch_artifacts(spark, folder: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) with status ok and content, or pruned where no commit holds the path any more."""
    found = newest_versions(spark.read.format("artifacts").option("path", folder).load()).select("path", "content")
    out = wanted.select("path").join(found, "path", "left")
    return out.withColumn("status", F.when(F.col("content").isNull(), "pruned").otherwise("ok"))
