"""A corpus as immutable table versions behind one small pointer: readers see a whole version, writers swap the pointer last.

A version names the folders of Parquet files that make up each table; unchanged folders are referred to, not copied. Segments
are kept in groups of editions: adding one writes a folder beside the others, removing or repairing one rewrites the group it is in
and no other. A group of many editions, such as a whole table that was committed, is not rewritten for one: the version notes which
of its editions are gone, and readers leave them out; once MOST_GONE are, it is rewritten. So the cost follows the edition and not the
corpus. merge() joins small groups. The pointer of version N is written aside and renamed without overwriting: it is there whole or
not at all, and of two writers from the same base one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema

Group = dict  # folder, and the ids of its editions; None where they were not counted; gone: editions in the folder that are none of the group's
FEW, MOST_GONE = 64, 1024  # editions of a group that is rewritten for one, and editions noted as gone in a group


class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        where = self._at("versions")
        found = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return max((int(n[:-5]) for n in found if n.endswith(".json") and n[0] != "."), default=0)

    def tables(self, version: int | None = None) -> dict[str, list[Group]]:
        """The groups of each table."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, name: str, groups: list[Group]) -> DataFrame:
        form, whole = schema.TABLES[name], [g for g in groups if not g.get("gone")]
        read = lambda *few: self.spark.read.schema(form).parquet(*[f"{self.path}/{g['folder']}" for g in few])
        parts = [read(*whole)] if whole else [] if groups else [self.spark.createDataFrame([], form)]
        parts += [read(g).where(~F.col("edition_id").isin(g["gone"])) for g in groups if g.get("gone")]
        return reduce(DataFrame.unionByName, parts)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; before init() an empty one of the right columns."""
        return self._read(name, self.tables(version).get(name, []))

    def edition(self, edition_id: int, version: int | None = None) -> DataFrame:
        """The segments of one edition, from the groups that can hold it."""
        groups = [g for g in self.tables(version).get("segments", []) if (g["editions"] is None or edition_id in g["editions"]) and edition_id not in g.get("gone", ())]
        return self._read("segments", groups).where(F.col("edition_id") == edition_id)

    def init(self) -> int:
        """Create the tables if there is no version yet."""
        return self.version() or self.commit({n: self.spark.createDataFrame([], f) for n, f in schema.TABLES.items()}, 0)

    def _written(self, name: str, df: DataFrame, editions: list[int] | None = None) -> Group:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.TABLES[name]])
        rows = rows.repartition("edition_id").sortWithinPartitions("edition_id", "seq") if name == "segments" else rows
        rows.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "editions": editions}

    def _publish(self, tables: dict[str, list[Group]], version: int) -> None:
        aside, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:012d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(aside), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise schema.CorpusError(f"version {version} exists: another writer was first") from None
            raise

    def commit(self, changed: dict[str, DataFrame], base: int, editions: dict[int, DataFrame | None] | None = None) -> int:
        """Publish version base + 1: whole tables in changed, and for each id in editions its new segments (None: it has none any more)."""
        if self.read_only:
            raise schema.ReadOnly("this store is open for reading only")
        if self.version() != base:
            raise schema.CorpusError(f"version {base} is not the newest: another writer was first")
        tables = dict(self.tables(base))
        for name, df in changed.items():
            tables[name] = [self._written(name, df)]
        if editions:
            tables["segments"] = [g for old in tables.get("segments", []) for g in self._without(old, set(editions))]
            for edition_id, df in editions.items():
                if df is not None:
                    tables["segments"].append(self._written("segments", df, [edition_id]))
        self._publish(tables, base + 1)
        return base + 1

    def _without(self, group: Group, gone: set[int]) -> list[Group]:
        """The group without some editions: itself if it has none of them, nothing if it has no other, and a group of many with them noted as gone."""
        have = None if group["editions"] is None else set(group["editions"])
        if have is not None and not have & gone:
            return [group]
        rest = None if have is None else sorted(have - gone)
        if rest == []:
            return []
        rows = self._read("segments", [group])
        if have is None and rows.where(F.col("edition_id").isin(list(gone))).isEmpty():
            return [group]
        noted = sorted({*group.get("gone", ()), *(gone if have is None else have & gone)})
        if (have is None or len(have) > FEW) and len(noted) <= MOST_GONE:
            return [group | {"editions": rest, "gone": noted}]
        return [self._written("segments", rows.where(~F.col("edition_id").isin(list(gone))), rest)]

    def merge(self, most: int = 64) -> int:
        """Write groups of fewer than most editions together as one; the newest version."""
        base = self.version()
        tables = dict(self.tables(base))
        small = [g for g in tables.get("segments", []) if g["editions"] is not None and len(g["editions"]) < most]
        if len(small) < 2:
            return base
        ids = sorted(i for g in small for i in g["editions"])
        tables["segments"] = [g for g in tables["segments"] if g not in small] + [self._written("segments", self._read("segments", small), ids)]
        if self.read_only:
            raise schema.ReadOnly("this store is open for reading only")
        self._publish(tables, base + 1)
        return base + 1

    def change(self, make: Callable[[int], dict[str, DataFrame]]) -> int:
        """Commit what make(base) returns, on the newest version."""
        base = self.version()
        return self.commit(make(base), base)
