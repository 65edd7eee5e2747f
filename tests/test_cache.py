"""Commits, writers beside each other, and what a lookup reads."""

import threading

from pyspark.sql import functions as F

from codelake.sources.cache import DocCache

ROW = "key string, language string, details string"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def held(cache):
    return {r["key"]: (r["language"], r["details"]) for r in cache.rows().collect()}


def test_last_row_wins_and_sums(spark, tmp_path):
    cache = DocCache(spark, f"file://{tmp_path}/c", 4)
    assert held(cache) == {} and cache.stats()["entries"] == 0
    cache.put(batch(spark, ("a", "py", "1"), ("b", "js", "1"), (None, "py", "0")))
    cache.put(batch(spark, ("a", "py", "2")))
    want = {"a": ("py", "2"), "b": ("js", "1"), None: ("py", "0")}
    assert held(cache) == want
    cache.compact()
    assert held(cache) == want and len(cache._live()) == 1
    cache.put(batch(spark, ("b", "js", "3")))
    cache.compact()
    assert held(cache) == want | {"b": ("js", "3")} and len(cache._live()) == 1
    hits, misses = cache.lookup(spark.createDataFrame([("b",), ("x",), ("x",)], "key string"))
    assert [tuple(r) for r in hits.collect()] == [("b", "3")] and misses.count() == 2
    cache.clear()
    assert held(cache) == {}


def test_two_writers(spark, tmp_path):
    """Eight writers at once: each batch is there."""
    cache = DocCache(spark, f"file://{tmp_path}/c", 2)
    threads = [threading.Thread(target=cache.put, args=(batch(spark, (f"k{i}", "py", str(i))),)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(cache) == {f"k{i}": ("py", str(i)) for i in range(8)}
    # a writer that comes while another sums up stays newer than the sum
    live = cache._live()
    folder = cache._write(cache.rows())
    cache.put(batch(spark, ("k0", "py", "new")))
    cache._commit(folder, live)
    assert held(cache)["k0"] == ("py", "new") and len(held(cache)) == 8 and len(cache._live()) == 2


def test_broken_writes_are_not_seen(spark, tmp_path):
    cache = DocCache(spark, f"file://{tmp_path}/c", 2)
    cache.put(batch(spark, ("a", "py", "1")))
    cache._write(batch(spark, ("a", "py", "lost")))  # died before its marker
    (tmp_path / "c/commits/_draft").write_text("")  # died before the rename
    assert held(cache) == {"a": ("py", "1")}
    cache.put(batch(spark, ("a", "py", "2")))
    assert held(cache) == {"a": ("py", "2")}


def test_lookup_reads_hit_buckets(spark, tmp_path):
    cache = DocCache(spark, f"file://{tmp_path}/c", 16)
    cache.put(spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("py").alias("language"), F.lit("d").alias("details")))
    wanted = spark.createDataFrame([("k7",), ("k8",)], "key string")
    for few in (1000, 1):
        hits, _ = cache.lookup(wanted, few)
        files = {f for f in hits.inputFiles() if "bucket=" in f}
        buckets = {r[0] for r in wanted.select(cache._bucket(F.col("key"))).collect()}
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert hits.count() == 2 and len(files) >= len(buckets)
    off = DocCache(spark, None)
    hits, misses = off.lookup(wanted)
    assert hits.count() == 0 and misses.count() == 2 and off.rows().count() == 0
