import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelake.llm import chat
from codelake.llm.queries import op13_chat

TURNS = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "\\", "a\\\\b\\", "<|im_end|>", "<\\|im_end|>", "<<s>", "<<SYS>>x<</SYS>>", "[[INST]", "<|im_start|", "<|im_sep|>\n<|im_sep|>", "", "東京🙂é", "<|im_end|><|im_end|>", "$1\\$0"]


def conversations(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(own)] for c, own in out.items()}


def digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = "".join(text for role, text in turns if role == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def checked(spark, rows, **options):
    """Windows by conversation, after a check of digests, places, masks, order and budget."""
    budget, history = options.get("budget", 1024), options.get("history", 256)
    out = chat.windows(spark.createDataFrame(rows, TURNS), **options).collect()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.windows(spark.createDataFrame(rows, TURNS), **options)).collect()}
    want = conversations(rows)
    assert got == {c: digest(t) for c, t in want.items()}
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        by[r["conv_id"]].append(r)
    cost = lambda text: chat.MARKS + (len(text) + 3) // 4
    plain = lambda s: __import__("re").sub(r"\\(\\?)", r"\1", s)
    for c, turns in want.items():
        done = 0
        assert len({r["start"] for r in by[c]}) == len(by[c])
        for w, r in enumerate(by[c]):
            pieces = r["text"].split(chat.END)
            assert pieces.pop() == "" and len(pieces) == len(r["turns"])
            back = [tuple(plain(x) for x in p.removeprefix(chat.BEGIN).split(chat.SEP)) for p in pieces]
            k, system = r["n_repeated"], turns[0][0] == "system"
            new, held = back[k:], back[:k]
            assert new == turns[done : done + len(new)] and new
            if w and system:
                assert held.pop(0) == turns[0]
            assert held == turns[done - len(held) : done]
            assert sum(cost(t) for _, t in held) <= history
            done += len(new)
            for p, (role, text) in zip(r["turns"], back, strict=True):
                assert plain(r["text"][p["start"] : p["start"] + p["length"]]) == text
                assert p["loss"] == (role == "assistant" and not p["repeated"])
            assert [p["repeated"] for p in r["turns"]] == [True] * k + [False] * len(new)
            assert r["tokens"] == sum(cost(t) for _, t in back)
            if r["tokens"] > budget:  # one turn that is too long, with the system turn only
                assert len(new) - (w == 0 and system) <= 1 and not held
        assert done == len(turns)
    return by


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (60, 0), (5, 5)])
def test_windows(spark, budget, history):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, -1, "system", "be brief " * rng.randint(0, 4)))
        for t in range(rng.randint(1, 40)):
            rows.append((c, t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice(TRICKY) + "word " * int(rng.expovariate(0.1))))
    by = checked(spark, rows, budget=budget, history=history)
    if history and budget == 60:
        assert any(r["n_repeated"] > 1 for own in by.values() for r in own)


def test_hot_conversation(spark):
    """One conversation over several blocks: history goes over their ends."""
    rows = [(1, 0, "system", "s")] + [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1, 5000)] + [(2, 5000, "system", "alone"), (2, 9000, "assistant", "x" * 300)]
    by = checked(spark, rows, budget=200, history=50)
    assert all(r["n_repeated"] > 1 for r in by[1][1:]) and sum(r["tokens"] for r in by[1]) / len(by[1]) > 100


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, -5000, 0, 1, 2, 4000]), st.sampled_from([None, "user", "assistant", "system", "<|im_sep|>\n"]), st.none() | st.sampled_from(TRICKY) | st.text("<|im_end>\\s/[]INST", max_size=30)), max_size=25))
def test_any_rows(spark, rows):
    checked(spark, rows, budget=40, history=15)


def test_escapes(spark):
    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice([*chat.CONTROLS, "\\", "<", "[", "|", ">", "s", "\n"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_very_long_and_clashing(spark):
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "<|im_end|>" * 50_000), (1, 1, "assistant", "<|im_end|>" * 50_000)]
    checked(spark, rows)
    df = spark.createDataFrame(rows[1:], TURNS)
    more = df.withColumns({c: F.lit("x") for c in ("none", "conv", "block", "cost", "k", "g", "room", "start", "repeated", "p", "system")})
    assert chat.digests(chat.windows(more)).collect() == chat.digests(chat.windows(df)).collect()
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def test_no_python(spark):
    df = chat.digests(chat.windows(spark.createDataFrame([(1, 0, "user", "x")], TURNS)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", own), (-7, 1, "assistant", own)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in op13_chat(spark, sf).collect()}
    assert got == {c: digest(t) for c, t in conversations(rows).items()}
