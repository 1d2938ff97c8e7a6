"""Sharding by size-tiered compaction, in DataFrame operations only.

``append`` writes an arrival as small immutable shards, as its partitions hold it, without a shuffle. ``compact``
puts shards of one size tier (tiers are powers of ``FANOUT``) into bins of about the target size, in blocks of
bounded shard counts, and merges each bin that has ``FANOUT`` shards, or half the target, into one file. Each step
ends in a manifest of the live shards; its version is committed by renaming a pointer file, which fails if the
version exists, so of two writers one wins and readers see the old or the new version whole. Files are never
changed; ``vacuum`` deletes those that no kept version names.

Only the folders that hold live shards are read, for a compaction only those of the shards it merges; bins are dealt
to tasks by ranges of their names. Every row is kept as it is, nulls, repeated rows and all columns included, whatever
the columns' names. A shard holds at most ``shard_rows``
rows and merged files at most about the target and one shard, whatever the keys, so no key makes a shard large. An
empty arrival gives a version without new shards.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import free_name, shared_path

FANOUT = 4
BASE_BYTES = 1 << 16
#: Shards that one window of the planner orders.
PLANNED = 1024
MANIFEST = T.StructType([T.StructField("shard", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("tier", T.IntegerType())])


class CommitConflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    """A table of shards below root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = 128 << 20, shard_rows: int = 2000):
        self.spark, self.root, self.schema = spark, root, schema
        self.target, self.shard_rows = target_bytes, shard_rows
        self.shard, self.size, self.bin = (free_name(n, schema.names) for n in ("_shard", "_size", "lodestone_bin"))
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _commit_dir(self) -> str:
        return f"{self.root}/commits"

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        folder = self._path(self._commit_dir())
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _pointer(self, version: int) -> str:
        stream = self._files.open(self._path(f"{self._commit_dir()}/{version:08d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: shard, rows, bytes, tier."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._pointer(version)}")

    def commit(self, manifest: DataFrame, version: int) -> int:
        """Writes the manifest, then makes it the version by one rename that fails if the version exists."""
        name = uuid.uuid4().hex
        manifest.select(*MANIFEST.names).write.parquet(f"{self.root}/manifests/{name}")
        folder = self._path(self._commit_dir())
        self._files.mkdirs(folder)
        waiting = self._path(f"{self._commit_dir()}/_{name}")
        stream = self._files.create(waiting, True)
        stream.writeUTF(name)
        stream.close()
        context = self.spark.sparkContext
        rename = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), context._jsc.hadoopConfiguration())
        plain = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            rename.rename(waiting, self._path(f"{self._commit_dir()}/{version:08d}"), plain)
        except Py4JJavaError as e:
            self._files.delete(waiting, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    # shards

    def _data(self, folders: list[str]) -> DataFrame:
        """The rows of data folders with the file that each lies in and its size."""
        own = [F.col(f"`{c}`") for c in self.schema.names]
        if not folders:
            return self.spark.createDataFrame([], self.schema).select(*own, F.lit("").alias(self.shard), F.lit(0).cast("long").alias(self.size))
        read = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/data/{f}" for f in folders))
        file = read.metadataColumn("_metadata")
        return read.select(*own, file["file_path"].alias(self.shard), file["file_size"].alias(self.size))

    def _folders(self, shards: DataFrame) -> list[str]:
        """The data folders of shards: at most one for each commit."""
        return sorted(r[0] for r in shards.select(F.regexp_extract("shard", "/data/([0-9a-f]{32})/", 1)).distinct().collect())

    def _listed(self, folder: str) -> DataFrame:
        """The manifest rows of a data folder's files."""
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / BASE_BYTES) / F.log(F.lit(float(FANOUT))))).cast("int")
        return self._data([folder]).groupBy(F.col(self.shard).alias("shard"), F.col(self.size).alias("bytes")).agg(F.count("*").alias("rows")).withColumn("tier", tier)

    def append(self, arrival: DataFrame) -> int:
        """Adds the arrival's rows as shards and commits the next version."""
        version, folder = self.version(), uuid.uuid4().hex
        arrival.select(*(F.col(f"`{c}`") for c in self.schema.names)).write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return self.commit(self.manifest(version).unionByName(self._listed(folder).select(*MANIFEST.names)), version + 1)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(shard, bin) of the shards that are to be merged."""
        small = manifest.where(F.col("bytes") < self.target / 2)
        blocks = max(1, -(-small.count() // PLANNED))
        # a block's bins come from the running sizes of its shards of one tier
        run = Window.partitionBy("tier", "block").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = small.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(blocks))).withColumn("turn", F.floor((F.sum("bytes").over(run) - F.col("bytes")) / self.target))
        whole = placed.groupBy("tier", "block", "turn").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
        whole = whole.where((F.col("n") > 1) & ((F.col("n") >= FANOUT) | (F.col("size") >= self.target / 2)))
        return placed.join(whole, ["tier", "block", "turn"]).select("shard", F.concat_ws("-", "tier", "block", "turn").alias("bin"))

    def compact(self) -> int:
        """Merges what the plan bins and commits the next version; without such bins the version stays."""
        version, folder = self.version(), uuid.uuid4().hex
        now = self.manifest(version)
        plan = self.plan(now)
        path = f"{self.root}/plans/{folder}"
        plan.write.parquet(path)  # the bins stay as planned if a task runs again
        plan = self.spark.read.schema("shard string, bin string").parquet(path)
        bins = plan.select("bin").distinct().count()
        if not bins:
            return version
        own = [F.col(f"`{c}`") for c in self.schema.names]
        rows = self._data(self._folders(plan)).join(plan.select(F.col("shard").alias(self.shard), F.col("bin").alias(self.bin)), self.shard).select(*own, self.bin)
        # by ranges, so that neighbouring bins share a task only where the bounds of equal shares do; by hash several would meet
        rows.repartitionByRange(bins, self.bin).write.partitionBy(self.bin).option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        kept = now.join(plan, "shard", "left_anti")
        return self.commit(kept.unionByName(self._listed(folder).select(*MANIFEST.names)), version + 1)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the column self.shard, the file that holds each."""
        live = self.manifest(version)
        return self._data(self._folders(live)).drop(self.size).join(live.select(F.col("shard").alias(self.shard)), self.shard, "left_semi")

    def vacuum(self) -> None:
        """Deletes the files that the latest version doesn't name, folder by folder. Readers of older versions must have ended."""
        live, base = self.manifest(), self._path(f"{self.root}/data")
        used = set(self._folders(live))
        for status in self._files.listStatus(base) if self._files.exists(base) else []:
            name = status.getPath().getName()
            if name not in used:
                self._files.delete(status.getPath(), True)
                continue
            named = {self._path(r["shard"]).toUri().getPath() for r in live.where(F.col("shard").contains(f"/data/{name}/")).select("shard").toLocalIterator()}
            files = self._files.listFiles(status.getPath(), True)
            while files.hasNext():
                path = files.next().getPath()
                if path.getName().endswith(".parquet") and path.toUri().getPath() not in named:
                    self._files.delete(path, False)


#: Shards that don't hold what the manifest says are broadcast up to this number; beyond it they are joined.
ODD = 1000


def sharded(docs: DataFrame, target_bytes: int = 32 << 20, shard_rows: int = 2000, arrivals: int = 3) -> DataFrame:
    """Appends docs as several arrivals with compactions between them, and reads the committed version back: doc_id, n_bytes, text_sha256, listed.

    listed: the row's shard holds as many rows as the manifest says. Text null: n_bytes and text_sha256 null.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, shared_path(spark, "shards"), docs.schema, target_bytes, shard_rows)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(turn == k))
        version = store.compact() if k else store.version()
    live = store.manifest(version)
    data = store._data(store._folders(live))
    rows = data.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), F.col(store.shard).alias("shard"))
    held = data.groupBy(F.col(store.shard).alias("shard")).agg(F.count("*").alias("held"))
    odd = live.join(held, "shard", "left").where(~F.col("held").eqNullSafe(F.col("rows"))).select("shard", F.lit(False).alias("listed"))
    odd = F.broadcast(odd) if odd.limit(ODD + 1).count() <= ODD else odd
    # files of live folders that were merged away since aren't read
    dead = held.join(live, "shard", "left_anti").select("shard")
    rows = rows.join(F.broadcast(dead) if dead.limit(ODD + 1).count() <= ODD else dead, "shard", "left_anti")
    return rows.join(odd, "shard", "left").select("doc_id", "n_bytes", "text_sha256", F.coalesce("listed", F.lit(True)).alias("listed"))
