"""Sharding with size-tiered compaction (operator 6), in DataFrame functions alone.

A store is a folder of immutable Parquet shards and versioned manifests. append() writes small shards
and commits a manifest that lists them as well. compact() merges runs of similar size into
files of about the target size and commits a manifest with those in their place. A version exists once its manifest file does: it is
written aside and renamed without overwriting, so of two writers one wins and the other gets a
CommitConflict; files of failed jobs are in no manifest. Readers open a manifest's files and see one version throughout.

Scale: merging reads whole files into a given number of writers without a shuffle, so no key can be
hot and each row is written once a tier. The driver handles file names and sizes, never rows.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import drop_path, scratch_path

MB = 1 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


def file_name() -> Column:
    """The name of the file that a row is read from; names of shards hold no characters that addresses escape."""
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


@dataclass(frozen=True)
class Shard:
    """path is relative to the store; tier 0 for arrivals, then one more than the highest it was merged from."""

    path: str
    bytes: int
    rows: int
    tier: int


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        where = self._path("manifest")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """The version, its shards and its schema; version 0 is the empty store."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, [], None
        stream = self._fs.open(self._path(f"manifest/v{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return version, [Shard(**s) for s in got["shards"]], got["schema"]

    def _commit(self, base: int, shards: list[Shard], schema: str) -> int:
        aside, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{base + 1:012d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {base + 1} is taken") from None
            raise
        return base + 1

    def _listed(self, run: str, tier: int) -> list[Shard]:
        """The shards of a run that has been written: sizes from the file listing, row counts from the footers."""
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(run)) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        # Not by the hidden column _metadata, which a column of that name in the data would take the place of.
        rows = self.spark.read.parquet(f"{self.path}/{run}").select(file_name().alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        return [Shard(f"{run}/{r['name']}", files[r["name"]], r["n"], tier) for r in rows.orderBy("name").collect()]

    def append(self, df: DataFrame, rows_per_shard: int = 4096) -> int:
        """Write df as shards of at most rows_per_shard rows and commit. An empty df commits a version without new shards."""
        base, shards, schema = self.manifest()
        own = df.schema.json()
        if schema is not None and schema != own:
            raise ValueError("the store holds other columns")
        run = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.path}/{run}")
        return self._commit(base, [*shards, *self._listed(run, 0)], own)

    def plan(self, target: int, fanout: int) -> list[list[Shard]]:
        """Groups to merge: shards under half the target, sorted into tiers of sizes within a factor of fanout; a tier with at least fanout shards is merged."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.manifest()[1]:
            if s.bytes < target / 2:
                tiers.setdefault(int(math.log(max(s.bytes, 1), fanout)), []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= fanout]

    def compact(self, target: int = 128 * MB, fanout: int = 4) -> int:
        """Merge until no tier has fanout shards; returns the newest version.

        It comes to an end: a group of n shards, each under half the target, makes at most n / 2, rounded up.
        """
        if fanout < 2:
            raise ValueError("a tier is merged from two shards on")
        while groups := self.plan(target, fanout):
            base, shards, schema = self.manifest()
            made: list[Shard] = []
            for group in groups:
                run, size = f"data/{uuid.uuid4().hex}", sum(s.bytes for s in group)
                rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.path}/{s.path}" for s in group])
                rows.coalesce(max(1, math.ceil(size / target))).write.parquet(f"{self.path}/{run}")
                made += self._listed(run, 1 + max(s.tier for s in group))
            gone = {s.path for g in groups for s in g}
            self._commit(base, [s for s in shards if s.path not in gone] + made, schema)
        return self.manifest()[0]

    def read(self, version: int | None = None) -> DataFrame:
        _, shards, schema = self.manifest(version)
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)))
        return reader.parquet(*[f"{self.path}/{s.path}" for s in shards]) if shards else self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))

    def shards(self, version: int | None = None) -> DataFrame:
        """The manifest as rows: version, shard, path, bytes, rows, tier."""
        v, shards, _ = self.manifest(version)
        return self.spark.createDataFrame([(v, i, s.path, s.bytes, s.rows, s.tier) for i, s in enumerate(shards)], "version long, shard int, path string, bytes long, rows long, tier int")

    def expire(self, keep: int = 1) -> None:
        """Forget all but the newest versions and delete files that none of those lists. Call it when no job still writes or reads older ones."""
        newest = self.versions()[-keep:]
        live = {s.path for v in newest for s in self.manifest(v)[1]}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:012d}.json"), False)
        if self._fs.exists(self._path("data")):
            for run in self._fs.listStatus(self._path("data")):
                name = run.getPath().getName()
                files = [f.getPath() for f in self._fs.listStatus(run.getPath())]
                kept = [f for f in files if f"data/{name}/{f.getName()}" in live]
                if not kept:
                    self._fs.delete(run.getPath(), True)
                    continue
                for f in files:
                    if f not in kept and f.getName().endswith(".parquet"):
                        self._fs.delete(f, False)


def compacted(docs: DataFrame, target: int = 32 * MB, fanout: int = 4, rows_per_shard: int = 2048, arrivals: int = 3) -> DataFrame:
    """docs in several arrivals, each appended as small shards and followed by a compaction; a row per document with the shard of the final version that holds it.

    doc_id, version, shard (place in the manifest), tier, text_crc32 and n_bytes (0 for null texts, whose
    checksum is null). An arrival is the rows whose hash of doc_id says so. Every row of docs is in exactly one shard,
    repeated rows and null ids included; an empty table has no rows. Only doc_id and text are stored.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch_path(spark, "shards"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    version = 0
    for i in range(arrivals):
        store.append(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i), rows_per_shard)
        version = store.compact(target, fanout)
        store.expire()
    if not store.manifest(version)[1]:
        return spark.createDataFrame([], "doc_id long, version long, shard int, tier int, text_crc32 long, n_bytes long")
    held = store.read(version).select("doc_id", F.crc32("text").alias("text_crc32"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), file_name().alias("name"))
    # The manifest's size follows the number of files, and the join may broadcast it only under Spark's own size check.
    shards = store.shards(version).select("version", "shard", "tier", F.element_at(F.split("path", "/"), -1).alias("name"))
    return held.join(shards, "name").select("doc_id", "version", "shard", "tier", "text_crc32", "n_bytes")


__all__ = ["CommitConflict", "Shard", "ShardStore", "compacted", "drop_path"]
