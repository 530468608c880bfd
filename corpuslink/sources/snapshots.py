"""Several tables that change as one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class Snapshots:
    """Versions of a set of tables below a path.

    A commit writes the tables that change to folders of their own, beside the old ones, and then one small file that names
    the folder of every table. Until that file is there readers see the version before, whatever has been written of
    this one, so that a failure between two tables changes nothing. A version is immutable: readers that have begun on one
    finish on it. What a failed commit has written is named by no version and stays as unread files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _named(self, version: int | None = None) -> tuple[int, str, dict[str, str]]:
        """(version, commit, table -> folder) of a version, the last one by default; version 0 has no tables."""
        try:
            log = self.spark.read.schema("commit string, tables map<string,string>, version int").parquet(f"{self.path}/commits")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return 0, "", {}
        if version is None:
            version = log.agg(F.max("version")).first()[0] or 0
        # Two writers can come to write one version at once; then the first commit by name stands, and the other one raises.
        found = log.where(F.col("version") == version).orderBy("commit").limit(1).collect()
        return (version, found[0]["commit"], found[0]["tables"]) if found else (0, "", {})

    def version(self) -> int:
        return self._named()[0]

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the last one by default."""
        return {name: self.spark.read.parquet(folder) for name, folder in self._named(version)[2].items()}

    def commit(self, changed: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the changed tables and makes them, with the others as they were, the next version after `base`.

        With a base that isn't the last version any more it raises Conflict, as the changes were made from old rows.
        """
        last, _, folders = self._named()
        if base is not None and base != last:
            raise Conflict(f"made from version {base}, but {last} is there")
        commit = uuid.uuid4().hex
        for name, df in changed.items():
            folders = {**folders, name: f"{self.path}/data/{name}/{commit}"}
            df.write.parquet(folders[name])
        row = self.spark.createDataFrame([(commit, folders)], "commit string, tables map<string,string>").coalesce(1)
        try:
            row.write.mode("errorifexists").parquet(f"{self.path}/commits/version={last + 1}")
        except AnalysisException as there:
            raise Conflict(f"version {last + 1} is there already") from there
        if self._named(last + 1)[1] != commit:
            raise Conflict(f"version {last + 1} was written by another commit")
        return last + 1
