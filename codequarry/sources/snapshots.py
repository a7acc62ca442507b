"""Versions of a set of tables in a folder, of which readers see one at a time.

A change writes its tables to new folders, is checked there, and is published by one small manifest whose name is the
next version. A manifest is written beside its name and moved there, which fails where the name is taken: of two writers that began from one version
only one publishes, and a writer that dies before leaves readers where they were. Going back publishes an old version's tables again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


class Taken(RuntimeError):
    """Another writer has published since."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self.path(f"{self.folder}/manifest-{version:010d}.json")

    def versions(self) -> list[int]:
        """The published versions, in order."""
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n[9:19]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def places(self, version: int | None = None) -> dict[str, str]:
        """By table, its folder in a version, the last if none is given; none before the first."""
        known = self.versions()
        if not known:
            return {}
        lines = self.spark.read.text(self._manifest(known[-1] if version is None else version).toString()).collect()  # one line
        return json.loads(lines[0][0])

    def tables(self, version: int | None = None) -> Tables:
        return {name: self.spark.read.parquet(where) for name, where in self.places(version).items()}

    def write(self, tables: Tables) -> dict[str, str]:
        """Tables written to folders of their own, which no reader knows yet."""
        places = {name: f"{self.folder}/{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(places[name])
        return places

    def publish(self, places: dict[str, str], after: int) -> int:
        """Make places the version behind `after` (0 if there is none); Taken if there is one already."""
        version = after + 1
        aside = self.path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(places, sort_keys=True).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._manifest(version), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(f"version {version} is published already") from e
            raise
        return version

    def run(self, change: Callable[[Tables], Tables], checks: dict[str, Callable[[Tables, Tables], bool]]) -> tuple[int | None, list[str]]:
        """Write what change makes of the last version's tables, and publish it if every check of (before, after) holds, read back from storage. The version, or
        None and the names of the checks that failed; then what was written is deleted."""
        before = (self.versions() or [0])[-1]
        old = self.tables(before) if before else {}
        kept = self.places(before) if before else {}
        made = self.write(change(old))
        after = {name: self.spark.read.parquet(where) for name, where in (kept | made).items()}
        failed = [name for name, check in checks.items() if not check(old, after)]
        if failed:
            for where in made.values():
                self.fs.delete(self.path(where), True)
            return None, failed
        return self.publish(kept | made, before), []

    def go_back(self, version: int) -> int:
        """Publish an old version's tables as the next version."""
        return self.publish(self.places(version), self.versions()[-1])
