"""Rewriting tables of documents with a way back.

A published table is a folder with versions of its rows (``data``) and manifests,
one a version, numbered. Publishing has two phases: rows are written beside what is
there, then the next manifest is put in place by a rename. Readers follow the last
manifest, so a writer that dies between the phases leaves the table as it was, and
of two writers of one version only one gets its manifest in. Earlier versions stay.
Any file system that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Published:
    """A table under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all versions, the last one current."""
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:08d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default of the current one."""
        every = self.versions()
        if not every or (version is not None and version not in every):
            raise LookupError(f"{self.root} has no version {version if version is not None else ''}".rstrip())
        found = self._manifest(every[-1] if version is None else version)
        return self.spark.read.parquet(f"{self.root}/data/{found['data']}")

    def stage(self, rows: DataFrame) -> str:
        """First phase: writes rows that no reader sees yet; returns their name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        return name

    def switch(self, data: str, after: int, note: str = "") -> int:
        """Second phase: makes staged rows the version after ``after``; refused if there is one by now."""
        version = after + 1
        target = self._path(f"{self.root}/manifests/{version:08d}")
        draft = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"data": data, "note": note}).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.root} was published meanwhile")
        return version

    def publish(self, rows: DataFrame, note: str = "") -> int:
        every = self.versions()
        return self.switch(self.stage(rows), every[-1] if every else 0, note)

    def restore(self, version: int) -> int:
        """Makes an earlier version's rows the current ones, as a version of their own."""
        every = self.versions()
        if version not in every:
            raise LookupError(f"{self.root} has no version {version}")
        return self.switch(self._manifest(version)["data"], every[-1], f"as version {version}")

    def rewrite(self, change: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> DataFrame:
        """Replaces texts by what ``change`` makes of ``(doc_id, text)``, rows ``(doc_id, text, changed, ...)``, and keeps the version before.

        Returns what changes: ``(doc_id, text, new_text, ...)``. A dry run, or a change
        of nothing, publishes nothing. Other columns stay. Ids are distinct.
        """
        every = self.versions()
        now = self.read()
        made = change(now.select("doc_id", "text")).where("changed").drop("changed").withColumnRenamed("text", "new_text")
        if not dry_run:  # written once, so that what is returned is what was published
            made = self.spark.read.parquet(f"{self.root}/data/{self.stage(made)}")
        report = now.select("doc_id", "text").join(made, "doc_id")
        if not dry_run and not made.isEmpty():
            new = now.join(made.select("doc_id", F.col("new_text").alias("__new")), "doc_id", "left")
            new = new.select(*[F.coalesce("__new", "text").alias("text") if c == "text" else F.col(c) for c in now.columns])
            self.switch(self.stage(new), every[-1], "rewritten")
        return report
