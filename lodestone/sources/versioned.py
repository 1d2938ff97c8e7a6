"""Tables that readers never see half-written: immutable folders, and a pointer that names those of a version.

A commit writes its rows to a folder of its own and then makes the next version by one rename that fails if the
version exists, so of two writers one wins and a reader sees the old or the new version whole. The pointer is a small JSON file: the
version's folders, and what it is about. Rows and folders of a failed or beaten commit are named by no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.operators.tables import anti_existing, upsert


class Conflict(Exception):
    """Another writer has committed the version."""


class VersionedTable:
    """The table below root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(self._conf)

    def version(self) -> int:
        """The latest version, 0 before the first."""
        folder = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def pointer(self, version: int | None = None) -> dict:
        """folders and about of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"folders": [], "about": {}, "schema": None}
        stream = self._files.open(self._path(f"{self.root}/versions/{version:08d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the latest by default; None before the first."""
        told = self.pointer(version)
        if told["schema"] is None:
            return None
        schema = T.StructType.fromJson(told["schema"])
        if not told["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in told["folders"]))

    def commit(self, rows: DataFrame, about: dict | None = None, append: bool = False, version: int | None = None) -> int:
        """Makes rows, or with append the latest rows and these, the next version (version, if it is given)."""
        latest = self.version() if version is None else version - 1
        before = self.pointer(latest)
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{folder}")
        told = {"folders": [*(before["folders"] if append else []), folder], "about": before["about"] if about is None else about, "schema": rows.schema.jsonValue()}
        versions = f"{self.root}/versions"
        self._files.mkdirs(self._path(versions))
        waiting, target = self._path(f"{versions}/_{folder}"), self._path(f"{versions}/{latest + 1:08d}")
        stream = self._files.create(waiting, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(waiting, target, plain)
        except Py4JJavaError as e:
            self._files.delete(waiting, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {latest + 1} exists") from e
            raise
        return latest + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the pointers of all but the last keep versions, then the folders that none of these names."""
        latest = self.version()
        held = {f for v in range(max(1, latest - keep + 1), latest + 1) for f in self.pointer(v)["folders"]}
        for v in range(1, latest - keep + 1):
            self._files.delete(self._path(f"{self.root}/versions/{v:08d}"), False)
        data = self._path(f"{self.root}/data")
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            if s.getPath().getName() not in held:
                self._files.delete(s.getPath(), True)


def save_document_index(new: DataFrame, root: str, attempts: int = 5) -> int:
    """Upserts (document_id, domain) entries with seq into the index at root; beaten by another writer, it takes that one's version and tries again."""
    index = VersionedTable(new.sparkSession, root)
    for left in range(attempts - 1, -1, -1):
        latest = index.version()
        old = index.read(latest)
        try:
            return index.commit(new if old is None else upsert(old, new, ["document_id", "domain"], "seq"), version=latest + 1)
        except Conflict:
            if not left:
                raise
    raise ValueError("at least one attempt")


class Progress:
    """Finished results of one evaluation, kept by batches; they count only for the same set of models and the same domain."""

    def __init__(self, spark: SparkSession, root: str, models: Iterable[str], domain: str):
        self.table = VersionedTable(spark, root)
        self.about = {"models": sorted(set(models)), "domain": domain}

    def done(self) -> DataFrame | None:
        """What is finished; None where nothing is, or where what is there belongs to other models or another domain."""
        latest = self.table.version()
        return self.table.read(latest) if self.table.pointer(latest)["about"] == self.about else None

    def left(self, work: DataFrame, keys: Iterable[str] = ("item_id", "model")) -> DataFrame:
        """The work that isn't finished."""
        done = self.done()
        return work if done is None else anti_existing(work, done, list(keys))

    def save(self, batch: DataFrame) -> int:
        """Adds a batch of results; after a change of models or domain it is the first one."""
        return self.table.commit(batch, self.about, append=self.done() is not None)

    def finish(self) -> None:
        """After success nothing is kept: later runs start anew."""
        latest = self.table.version()
        held = self.table.read(latest)
        if held is not None:
            self.table.commit(held.limit(0), {}, version=latest + 1)
            self.table.vacuum(keep=1)
