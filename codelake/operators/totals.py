"""Fact totals kept up by deltas of changed and removed files.

A project's totals are sums of what each file adds: rows of (path, fact, key, value). A batch takes
files as they are now and paths that are gone; of each touched file it stores the new rows less
those stored before, so sums over all batches equal the totals of a rebuild and only touched files are
read again. Highest values come from histograms (how many symbols of each complexity), as those add up too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, language_of

ROW = "path string, fact string, key string, value bigint"
_BY = ["path", "fact", "key"]


def contributions(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The ROWs of parsed files: ``files(path, n_functions, n_classes, n_imports)``, ``symbols(path, cyclomatic)``.

    Facts: files, functions, classes, imports (key empty), directory (every one above a file), language,
    and complexity (a histogram by the cyclomatic number, without nulls)."""
    entry = lambda fact, key, value: F.struct(F.lit(fact).alias("fact"), key.cast("string").alias("key"), F.coalesce(value.cast("long"), F.lit(0)).alias("value"))
    none, one = F.lit(""), F.lit(1)
    single = [entry("files", none, one), entry("functions", none, F.col("n_functions")), entry("classes", none, F.col("n_classes")), entry("imports", none, F.col("n_imports")), entry("language", language_of(F.col("path")), one)]
    above = F.transform(ancestors(F.col("path")), lambda d: entry("directory", d, one))
    out = files.select("path", F.inline(F.concat(F.array(*single), above)))
    if symbols is not None:
        out = out.unionByName(symbols.filter("cyclomatic is not null").groupBy("path", F.col("cyclomatic").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value")).select("path", F.lit("complexity").alias("fact"), "key", "value"))
    return out


class FactTotals:
    """Totals in a folder of any file system that Spark reads.

    A batch is written to a folder of its own and becomes visible by renaming its marker to the next
    number, which fails if another writer took that number; then the batch is worked out again on what
    the other left. A batch's name commits once: the same name again changes nothing. A lost executor
    or driver leaves at most a folder that no marker names. The rename must refuse an existing target,
    as HDFS does; a local file system checks and renames in two steps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[dict]:
        """number, folder, batches and whole (a sum of all earlier ones) of each commit, in order."""
        p = self._p("commits")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        out = []
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name[:1] not in "_.":
                opened = fs.open(f.getPath())
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")) | {"number": int(name)})
                finally:
                    opened.close()
        return sorted(out, key=lambda c: c["number"])

    def _commit(self, number: int, entry: dict) -> bool:
        """False if the number is taken."""
        jvm = self.spark._jvm
        draft, target = self._p(f"commits/_{uuid.uuid4().hex}"), self._p(f"commits/{number:010d}")
        fs = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        made = fs.create(draft, False)
        made.write(bytearray(json.dumps(entry).encode()))
        made.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(target):
                return False
            raise
        return True

    def _read(self, commits: list[dict]) -> DataFrame:
        """The signed rows of all commits from the last whole one on."""
        start = max((i for i, c in enumerate(commits) if c["whole"]), default=0)
        folders = [f"{self.path}/{c['folder']}" for c in commits[start:]]
        if not folders:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*folders)

    @staticmethod
    def _sum(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("value").alias("value")).filter("value <> 0")

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*_BY, "value").write.parquet(f"{self.path}/{folder}")
        return folder

    def apply(self, batch: str, changed: DataFrame, removed: DataFrame | None = None, attempts: int = 50) -> bool:
        """Take ``changed`` (ROWs of whole files, new or not) and ``removed(path)``; False if the batch was there.

        A path in both counts as changed; a removed path that is unknown adds nothing; rows of one
        (path, fact, key) are summed; a null key is a key; rows without a path or value go."""
        changed = changed.select("path", "fact", "key", F.col("value").cast("long").alias("value")).dropna(subset=["path", "fact", "value"])
        touched = changed.select("path")
        if removed is not None:
            touched = touched.unionByName(removed.select("path"))
        for _ in range(attempts):
            known = self.commits()
            if any(batch in c["batches"] for c in known):
                return False
            before = self._read(known).join(touched.distinct(), "path", "left_semi").withColumn("value", -F.col("value"))
            folder = self._write(self._sum(changed.unionByName(before), _BY))
            if self._commit(len(known), {"folder": folder, "batches": [batch], "whole": False}):
                return True
            self._drop(folder)
        raise RuntimeError(f"{attempts} other writers came before the batch {batch}")

    def compact(self) -> bool:
        """One sum of all batches so far, without what cancels out; False if a writer came meanwhile."""
        known = self.commits()
        if not known:
            return False
        folder = self._write(self._sum(self._read(known), _BY))
        done = self._commit(len(known), {"folder": folder, "batches": [], "whole": True})
        if not done:
            self._drop(folder)
        return done

    def _drop(self, folder: str) -> None:
        p = self._p(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def totals(self) -> DataFrame:
        """fact, key, value: the sums that are not zero."""
        return self._sum(self._read(self.commits()), ["fact", "key"])

    def highest(self, fact: str = "complexity") -> DataFrame:
        """One row, highest: the largest number in a histogram that still has entries; null if there is none."""
        return self.totals().filter(F.col("fact") == fact).agg(F.max(F.col("key").cast("long")).alias("highest"))
