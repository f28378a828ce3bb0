"""Versioned tables: every write makes a new immutable DataFrame; a commit swaps them in atomically.

Spark can't change plain tables in place, so a version is a plan over the one before it. What isn't certain to give the
same rows again (a caller's frame, a plan with random values) is written to the shared folder before it becomes part
of a version; after ``cut_after`` versions a table's lineage is cut in the same way.

With a ``path`` a table is a list of parquet files. A commit writes new files for the rows that are new and for those
files alone that hold changed rows, and then one small numbered file that lists all. It is put in place by a step that
fails where another process was faster; that commit is then read, and only if it changed the same tables does the
write fail. Readers see the last commit whole or not at all; a job that dies leaves the one before.
"""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from graphlake.schema import Schema, Table

COMMITS = "commits"
#: What Spark takes for so few bytes is written as one file.
FILE_BYTES = 32 << 20


class ConcurrentWrite(Exception):
    """Another commit changed a table that this one wrote."""


def _shared_folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return root or "file://" + tempfile.mkdtemp(prefix="graphlake-store-")


def file_name(uri: str) -> str:
    """One spelling of a file's name: Spark has several."""
    return re.sub("^file:/+", "file:/", unquote(uri))


class TableStore:
    def __init__(self, spark: SparkSession, schema: Schema, sources: dict, *, path: str | None = None, cut_after: int = 12):
        self.spark, self.schema, self.path, self.cut_after = spark, schema, path.rstrip("/") if path else None, cut_after
        self.lock = threading.Lock()
        self.frames: dict[str, DataFrame] = {}
        self.versions: dict[str, int] = {}
        self.files: dict[str, list[str]] = {}  # of the tables that commits have written
        self.commit_number = 0
        for name, table in schema.tables.items():
            source = sources.get(name, sources.get(table.source))
            if source is not None:
                self.frames[name] = table.scan(spark.read.parquet(source) if isinstance(source, str) else source)
                self.versions[name] = 0
        self._refresh()

    def scan_files(self, name: str, files: list[str]) -> DataFrame:
        schema = self.schema.tables[name].schema
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def snapshot(self) -> Snapshot:
        with self.lock:
            self._refresh()
            return Snapshot(self, dict(self.frames), dict(self.versions), dict(self.files))

    def commit(self, frames: dict[str, DataFrame], changed: set[str], base: dict[str, int], parts: dict[str, tuple[list[str], list[DataFrame]]]) -> None:
        """Swap in the changed tables, unless one of them has changed since ``base``. parts: of tables that keep
        files, these and the frames of their new rows."""
        if not self.path:
            new = {n: self._settled(n, frames[n]) for n in sorted(changed)}
            with self.lock:
                self._unchanged(changed, base)
                self._take(new, {})
            return
        files = {}
        for n in sorted(changed):
            kept, added = parts.get(n, ([], [frames[n]]))
            files[n] = [*kept, *self._written(reduce(DataFrame.unionByName, added), n)]
        with self.lock:
            while True:
                self._refresh()
                self._unchanged(changed, base)
                if self._write_commit(self.files | files):
                    self.commit_number += 1
                    return self._take({n: self.scan_files(n, files[n]) for n in files}, files)

    def _unchanged(self, changed: set[str], base: dict[str, int]) -> None:
        for n in changed:
            if self.versions.get(n, 0) != base.get(n, 0):
                raise ConcurrentWrite(n)

    def _take(self, frames: dict[str, DataFrame], files: dict[str, list[str]]) -> None:
        for n, df in frames.items():
            self.frames[n] = df
            self.versions[n] = self.versions.get(n, 0) + 1
        self.files |= files

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """The frame's rows as they are now, written to the shared folder."""
        path = f"{_shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _settled(self, name: str, df: DataFrame) -> DataFrame:
        return self.held(df, name) if (self.versions.get(name, 0) + 1) % self.cut_after == 0 else df

    def _written(self, df: DataFrame, name: str) -> list[str]:
        """The new files that hold the frame's rows."""
        path = f"{self.path}/{name}/v-{uuid.uuid4().hex}"
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        (df.coalesce(1) if size <= FILE_BYTES else df).write.parquet(path)
        return sorted(map(file_name, self.spark.read.schema(df.schema).parquet(path).inputFiles()))

    # the commits' files, through Hadoop's file systems

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _refresh(self) -> None:
        """Take in what other processes have committed."""
        if not self.path:
            return
        fs, folder = self._fs(f"{self.path}/{COMMITS}")
        numbers = [int(n.removesuffix(".json")) for n in (f.getPath().getName() for f in (fs.listStatus(folder) if fs.exists(folder) else [])) if n.endswith(".json") and n[0].isdigit()]
        last = max(numbers, default=0)
        if last > self.commit_number:
            files = json.loads(self.spark.read.text(f"{self.path}/{COMMITS}/{last:012d}.json", wholetext=True).first()[0])
            fresh = {n: f for n, f in files.items() if n in self.schema.tables and f != self.files.get(n)}
            self._take({n: self.scan_files(n, f) for n, f in fresh.items()}, fresh)
            self.commit_number = last

    def _write_commit(self, files: dict[str, list[str]]) -> bool:
        """Whether the next commit is this one. It is written beside and put in place whole: by a link on a local file
        system, else by a rename that doesn't overwrite, which the file system must do in one step."""
        fs, new = self._fs(f"{self.path}/{COMMITS}/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(files, sort_keys=True).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/{COMMITS}/{self.commit_number + 1:012d}.json")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        try:
            if fs.getUri().getScheme() == "file":
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, new)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(new, target, none)
            return True
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            return False
        finally:
            fs.delete(new, False)


class Snapshot:
    """The tables as a transaction sees them; savepoints are copies of the maps."""

    def __init__(self, store: TableStore, frames: dict[str, DataFrame], base: dict[str, int], files: dict[str, list[str]]):
        self.store, self.frames, self.base, self.changed = store, frames, base, set()
        self.files = files  # of tables that are as their files are
        self.parts: dict[str, tuple[list[str], list[DataFrame]]] = {}  # of changed tables that keep files

    def scan(self, name: str) -> DataFrame:
        return self.frames[name]

    def put(self, table: Table, df: DataFrame) -> None:
        """A table's new rows, all of them."""
        df = df.select(*table.columns)
        if not df._jdf.queryExecution().analyzed().deterministic():
            df = self.store.held(df, table.name)
        self.frames[table.name] = df
        self._mark(table.name)

    def append(self, table: Table, rows: DataFrame) -> None:
        """More rows of a table; its files stay."""
        name, rows = table.name, rows.select(*table.columns)
        kept, added = self.parts.get(name, (self.files.get(name), []))
        if kept is None:
            return self.put(table, self.frames[name].unionByName(rows))
        self.frames[name] = self.frames[name].unionByName(rows)
        self._mark(name, (kept, [*added, rows]))

    def replace(self, table: Table, kept: list[str] | None, df: DataFrame) -> None:
        """The rows of some of a table's files, anew; ``kept``: the other files (None: ``df`` has all rows)."""
        if kept is None:
            return self.put(table, df)
        df = df.select(*table.columns)
        if not df._jdf.queryExecution().analyzed().deterministic():
            df = self.store.held(df, table.name)
        self.frames[table.name] = self.store.scan_files(table.name, kept).unionByName(df)
        self._mark(table.name, (kept, [df]))

    def _mark(self, name: str, part: tuple | None = None) -> None:
        self.changed.add(name)
        self.files.pop(name, None)
        self.parts.pop(name, None)
        if part:
            self.parts[name] = part

    def mark(self) -> tuple:
        return dict(self.frames), set(self.changed), dict(self.files), dict(self.parts)

    def restore(self, mark: tuple) -> None:
        self.frames, self.changed, self.files, self.parts = dict(mark[0]), set(mark[1]), dict(mark[2]), dict(mark[3])

    def commit(self) -> None:
        if self.changed:
            self.store.commit(self.frames, self.changed, self.base, self.parts)
            self.changed = set()
