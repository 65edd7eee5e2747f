"""A cache of generated details: committed batches of bucketed Parquet, the last row of a key wins.

A batch is written to a folder of its own and becomes visible when its marker is renamed to
``commits/<number>-<id>``. So readers never see half a batch. Writers at the same time may take one number, but have
markers of their own, so none is lost; their order is that of the ids. Rows lie by a hash of their key in buckets, with Parquet's Bloom filters on
the key: a lookup reads the buckets that its keys fall into. :meth:`DocCache.compact` sums batches up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, language string, details string, bucket int"


class DocCache:
    """``path`` may be in any file system that Spark reads. Without a path the cache is off."""

    def __init__(self, spark: SparkSession, path: str | None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/") if path else None, buckets

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[dict]:
        """name, number, folder and replaces (the names that a summing batch stands for) of each commit, in order."""
        if not self.path:
            return []
        p, fs = self._at("commits")
        if not fs.exists(p):
            return []
        out = []
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if not name.startswith(("_", ".")):
                opened = fs.open(f.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
                finally:
                    opened.close()
                out.append(json.loads(text) | {"name": name, "number": int(name.partition("-")[0])})
        return sorted(out, key=lambda c: c["name"])

    def _live(self) -> list[dict]:
        """The commits that no other stands for."""
        every = self.commits()
        gone = {name for c in every for name in c["replaces"]}
        return [c for c in every if c["name"] not in gone]

    def _commit(self, folder: str, replaces: list[dict] | None = None) -> None:
        """A sum takes the number of its newest part, so that batches which came meanwhile are newer."""
        number = max((c["number"] for c in replaces or self.commits()), default=-1) + (not replaces)
        own = uuid.uuid4().hex
        draft, fs = self._at(f"commits/_{own}")
        made = fs.create(draft, False)
        made.write(bytearray(json.dumps({"folder": folder, "replaces": [c["name"] for c in replaces or []]}).encode()))
        made.close()
        if not fs.rename(draft, self._at(f"commits/{number:08d}-{own}")[0]):
            raise OSError(f"the commit of {folder} could not be renamed")

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.select("key", "language", F.col("details").cast("string")).withColumn("bucket", self._bucket(F.col("key")))
        kept = rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket")
        kept.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, where: Column | None = None, live: list[dict] | None = None) -> DataFrame:
        parts = None
        for c in self._live() if live is None else live:
            order = F.struct(F.lit(c["number"]).alias("n"), F.lit(not c["replaces"]).alias("single"), F.lit(c["name"]).alias("name"))
            part = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{c['folder']}").withColumn("order", order)
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return self.spark.createDataFrame([], "key string, language string, details string")
        parts = parts if where is None else parts.filter(where)
        last = F.max_by(F.struct("language", "details"), F.struct("order", "details")).alias("v")
        return parts.groupBy("key").agg(last).select("key", "v.language", "v.details")

    def rows(self) -> DataFrame:
        """key, language, details: the last written row of each key."""
        return self._read()

    def put(self, rows: DataFrame) -> None:
        """Append key, language, details as one batch."""
        if self.path:
            self._commit(self._write(rows))

    def compact(self) -> None:
        """One batch for all that are there now. Batches of other writers that come meanwhile stay newer."""
        live = self._live()
        if len(live) > 1:
            self._commit(self._write(self._read(live=live)), live)

    def lookup(self, wanted: DataFrame, few: int = 1000) -> tuple[DataFrame, DataFrame]:
        """(hits with ``details``, misses). Only buckets of wanted keys are read; up to ``few`` keys
        are also named to the scan, whose Bloom filters then skip what can't hold them."""
        if not self.path:
            return wanted.withColumn("details", F.lit("")).limit(0), wanted
        keys = wanted.select("key").distinct()
        hit = [r[0] for r in keys.select(self._bucket(F.col("key")).alias("b")).distinct().collect()]  # ``buckets`` at most
        where = F.col("bucket").isin(hit)
        named = [r[0] for r in keys.limit(few + 1).collect()]
        if len(named) <= few:
            where = where & F.col("key").isin([k for k in named if k is not None])
        known = self._read(where).select("key", "details")
        return wanted.join(known, "key"), wanted.join(known.select("key"), "key", "left_anti")

    def clear(self) -> None:
        if self.path:
            p, fs = self._at("")
            fs.delete(p, True)

    def stats(self) -> dict:
        by = {r["language"]: r["n"] for r in self.rows().groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"entries": sum(by.values()), "languages": by, "path": self.path}
