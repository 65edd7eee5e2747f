import hashlib
from collections import defaultdict

from codelake.llm import line_dedup
from codelake.llm.queries import op2_line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, min_docs=3, min_chars=20):
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        low = lambda v: float("-inf") if v is None else v
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and d != max(held[key(x)], key=low))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    from pyspark.sql import functions as F

    rows = line_dedup.keep_bitmaps(df).select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text().cast("binary"), 256).alias("s"))
    return sorted(map(tuple, rows.collect()), key=str)


def test_against_brute_force(spark):
    long = ["A shared line that is LONG enough", "a shared line that is long enough ", "\tÉtè shared ÉÉÉ line of text\r", "short", "x" * 19, "y" * 20, ""]
    docs = [(i, "\n".join(long[(i * k) % 7] for k in range(1, 3 + i % 9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n"), (103, "\n".join(["the same line in one document"] * 200)), (None, "y" * 20 + "\nz"), (None, "y" * 20 + "\nz"), (104, "\n".join(f"line {k} of many, many lines" for k in range(300))), (105, "\n".join(f"line {k} of many, many lines" for k in range(0, 300, 2))), (106, "\n".join(f"line {k} of many, many lines" for k in range(0, 300, 3)))]
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)) == brute(docs)


def test_hot_line(spark):
    docs = [(i, f"own line number {i} of this\n" + "the one line that everybody has") for i in range(500)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert got == brute(docs) and sum(r[2] for r in got) == 499


def test_odd_rows(spark, odd, none, clashing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(clashing(odd)) == brute(docs)
    assert run(none) == []
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    named = clashing(odd)
    assert line_dedup.dedup_lines(named).columns == named.columns


def test_query_is_native(spark):
    df = op2_line_dedup(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, df.collect()), key=str) == brute(docs)
