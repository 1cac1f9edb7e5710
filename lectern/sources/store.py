"""A folder of immutable table versions with one pointer file.

A new version is written next to the old ones, where no reader looks, and checked; then the pointer is replaced by a
rename. Readers follow the pointer, so they see the old or the new version of all tables at once. A failed or lost writer
leaves only a version that nothing points at. A version replaces a table, or adds rows to it: then only the new rows are
written, and the table is what lies in all its parts. ``compact`` makes one part of many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lectern.errors import LockedError, VerificationError

POINTER = "current.json"


class TableStore:
    """Tables under one folder of any file system that Spark can write to; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """Content of the pointer file: version, and for each table the versions that hold its parts; version 0 without tables if
        there is none."""
        at = self._path(POINTER)
        if not self._fs.exists(at):
            return {"version": 0, "tables": {}}
        text = "\n".join(r.value for r in self.spark.read.text(at.toString()).collect())
        return json.loads(text)

    def versions(self) -> list[int]:
        """Numbers of all versions on disk, published or not."""
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def stage(self, tables: dict[str, DataFrame]) -> int:
        """Write the tables as a new version that no reader sees; numbers are never used again."""
        version = max([*self.versions(), self.pointer()["version"]], default=0) + 1
        for name, rows in tables.items():
            rows.write.parquet(self._path(f"v{version}", name).toString())
        return version

    def publish(self, version: int, expected: dict[str, int] | None = None, adds: tuple[str, ...] = ()) -> None:
        """Point at a staged version, if all its tables are complete and have the expected numbers of rows.

        Tables named in ``adds`` gain the staged rows, the others are replaced; tables that were not staged stay as they are.
        """
        held = self._path(f"v{version}")
        if not self._fs.exists(held):
            raise VerificationError(f"version {version} was not staged")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(held))
        for name in names:
            if not self._fs.exists(self._path(f"v{version}", name, "_SUCCESS")):
                raise VerificationError(f"table {name} of version {version} is not complete")
        for name, count in (expected or {}).items():
            if name not in names or self.spark.read.parquet(self._path(f"v{version}", name).toString()).count() != count:
                raise VerificationError(f"table {name} of version {version} does not have {count} rows")
        tables = dict(self.pointer()["tables"])
        for name in names:
            tables[name] = [*(tables.get(name, []) if name in adds else []), version]
        fresh = self._path(f"{POINTER}.{version}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, self._path(POINTER), options)

    def staged(self, version: int, name: str) -> DataFrame:
        """A table as it was staged, published or not."""
        return self.spark.read.parquet(self._path(f"v{version}", name).toString())

    def read(self, name: str) -> DataFrame:
        """A table of the published version."""
        held = self.pointer()
        if name not in held["tables"]:
            raise VerificationError(f"no published table {name}")
        return self.spark.read.parquet(*(self._path(f"v{part}", name).toString() for part in held["tables"][name]))

    def compact(self, name: str, files: int | None = None) -> int:
        """Write a table of several parts as one, and point at it; returns the version."""
        rows = self.read(name)
        version = self.stage({name: rows if files is None else rows.repartition(files)})
        self.publish(version)
        return version

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Hold the store as its only writer: a file that can be created once. Another holder is an error, not a wait."""
        at = self._path("writer.lock")
        try:
            self._fs.create(at, False).close()
        except Exception as problem:  # the gateway wraps what the file system throws
            raise LockedError(f"{self.folder} is held by another writer") from problem
        try:
            yield
        finally:
            self._fs.delete(at, False)

    def clean(self, keep: int = 1) -> list[int]:
        """Delete versions that hold no part of a table but the last ``keep`` of them; returns the deleted ones."""
        held = self.pointer()
        used = {part for parts in held["tables"].values() for part in parts}
        older = [v for v in self.versions() if v < held["version"] and v not in used]
        gone = older[: len(older) - keep] if keep else older
        for v in gone:
            self._fs.delete(self._path(f"v{v}"), True)
        return gone
