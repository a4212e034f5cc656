"""Tables of versions: data goes to a folder of its own, and a small file written last makes it count.

A reader sees only what a commit file names, so a write that fails half-way leaves the older version whole, and a writer that is run
again finds its commit and does nothing. Commit files are made under another name and renamed, which file systems
do at once; a version that another writer has taken in the meantime is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commits:
    """The commit files of a table at `path`, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{name}" if name else f"{self.path}/_commits")

    def names(self) -> list[str]:
        """Committed names, in order; files still being written don't count."""
        if not self.fs.exists(self.at("")):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.at(""))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, name: str, entry: dict) -> None:
        """Make an entry count; FileExistsError if the name is taken."""
        hidden = self.at(f".{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(hidden, self.at(name)):
            self.fs.delete(hidden, False)
            raise FileExistsError(f"{self.path}: {name} is committed already")


def new_folder(path: str) -> str:
    return f"{path}/data-{uuid.uuid4().hex}"


def write_version(records: DataFrame, path: str) -> int:
    """A whole new version of a table, as gzip JSON lines; returns its number. Readers see it once it is complete (SNK2)."""
    commits = Commits(records.sparkSession, path)
    version = 1 + max(map(int, commits.names()), default=0)
    folder = new_folder(path)
    records.write.option("compression", "gzip").json(folder)
    commits.commit(f"{version:010d}", {"folder": folder.rsplit("/", 1)[1], "schema": records.schema.json()})
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or one by its number."""
    from pyspark.sql import types as T

    commits = Commits(spark, path)
    names = commits.names()
    if not names:
        raise FileNotFoundError(f"{path} has no committed version")
    entry = commits.read(names[-1] if version is None else f"{version:010d}")
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).json(f"{path}/{entry['folder']}")


def append(records: DataFrame, path: str, batch: str, by: str = "type") -> bool:
    """Append accepted records as a batch, in folders by a column (SNK1); False if the batch is there already, so a
    job that is run again adds nothing twice. A batch's name has letters, digits, - and . only."""
    if not batch or not all(c.isalnum() or c in "-." for c in batch) or batch.startswith("."):
        raise ValueError(f"not a name of a batch: {batch!r}")
    commits = Commits(records.sparkSession, path)
    if batch in commits.names():
        return False
    folder = new_folder(path)
    records.write.partitionBy(by).parquet(folder)
    try:
        commits.commit(batch, {"folder": folder.rsplit("/", 1)[1], "schema": records.schema.json()})
    except FileExistsError:
        return False
    return True


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All committed batches, with `batch`; columns that a batch doesn't have are null."""
    from pyspark.sql import types as T

    commits, out = Commits(spark, path), None
    for name in commits.names():
        entry = commits.read(name)
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        d = spark.read.schema(schema).option("basePath", f"{path}/{entry['folder']}").parquet(f"{path}/{entry['folder']}").withColumn("batch", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"{path} has no committed batch")
    return out
