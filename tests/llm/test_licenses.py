from codelake.llm import licenses
from codelake.llm.queries import op6_licenses
from codelake.llm.words import alnum_words

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    w = [x.decode("utf-8", "replace") for x in alnum_words(text)]
    hits = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_words_follow_the_pattern():
    import regex

    for t in ("Don't stop-me NOW 3.0", "ñandú Ünder_score 东京🙂x", "", "a\x00b\x7fc\x80d", "ÀBC"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert [w.decode() for w in alnum_words(t)] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_exact_and_near(spark):
    texts = [
        "Released under the MIT License.", "the M-I-T license", "mit\nLICENSE, cc by cc by", "GNU General Public License GNU General Public License",
        "under the gnu genral public licence v3", "mitlicense", "submit license", "cc byx", "Apache  License,,, Version 2.0", "nothing here", None, "",
        "permission is hereby granted free of charge to any persn obtaining a copi",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert "gpl" in got[4]["labels"] and got[4]["n_base"] == 0 and 0 < got[4]["score"] < 1
    assert "mit" in got[12]["labels"].split(",") and got[9]["labels"] == "" and got[9]["score"] == 0
    span = got[4]["near"][0]
    assert span["first_word"] == 2 and span["edits"] == 2


def test_pieces_make_up_the_notice():
    for p, _, e in licenses.NOTICES:
        parts = licenses.pieces(p, e)
        assert b"".join(parts).decode() == p and len(parts) == e + 1 and all(parts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_edits(notice, text):
    """Edits of the nearest run of whole words."""
    w = [x.decode() for x in alnum_words(text)]
    n = len(notice.split())
    return min((distance(notice, " ".join(w[a:b])) for a in range(len(w)) for b in range(a + max(1, n - 3), min(len(w), a + n + 3) + 1)), default=99)


def test_word_ends():
    """Notices whose last or first letter is lost or added are found, with the least edits."""
    import random

    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    for text, label, edits in (
        ("under the gnu lesser general public licens as published", "lgpl", 1),
        ("gnu lesser general public licenses", "lgpl", 1),
        ("the mozilla public licens v 2", "mpl", 1),
        ("all rights reserve by us", "proprietary", 1),
        ("overall rights reserved", "proprietary", 3),
    ):
        found = [s for s in scanner.scan(text)[2] if s[0] == label]
        assert (min(s[3] for s in found) == edits) if edits < 3 else not found, text
    rng = random.Random(5)
    for notice, label, most in licenses.NOTICES:
        own = licenses.Scanner({}, [(notice, label, most)])
        for _ in range(12):
            s = list(notice)
            for _ in range(rng.randint(0, most + 1)):
                at = rng.choice((0, len(s) - 1, rng.randrange(len(s))))
                s[at : at + rng.randint(0, 1)] = rng.choice(("", "a", "s", "x"))
            if rng.random() < 0.5:
                s += rng.choice(("s", "x", "", ""))
            text = "words before " + "".join(s) + " as after"
            want = least_edits(notice, text)
            spans = own.scan(text)[2]
            assert bool(spans) == (want <= most), (text, want, spans)
            assert not spans or min(x[3] for x in spans) == want, (text, want, spans)
            for x in spans:
                assert distance(notice, x[4]) == x[3] and x[4] in " ".join(w.decode() for w in alnum_words(text))


def everywhere(text, notices):
    """The spans by the edit distance of every run of whole words, and the choice that the module states."""
    w = [x.decode() for x in alnum_words(text)]
    out = []
    for notice, label, most in notices:
        n = len(notice.split())
        options = []
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + n + most + 1) + 1):
                run = " ".join(w[a:b])
                if abs(len(run) - len(notice)) <= most and (d := distance(notice, run)) <= most:
                    options.append((d, a, b))
        taken = set()
        for d, a, b in sorted(options):
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                out.append((label, a, b - a, d, " ".join(w[a:b])))
    return sorted(out)


def test_spans_are_those_of_matching_everywhere(spark):
    """Several notices, changed ones beside whole ones, against edit distances everywhere."""
    import random

    rng = random.Random(11)
    notices = [n for n in licenses.NOTICES if len(n[0]) < 40]
    texts = ["mozila public licens mozilla public license", "mozilla public license mozila public licens", "gnu gnu general public license license", "all rights reserved all rights reserved all right reserved"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            notice, _, most = rng.choice(notices)
            s = list(notice)
            for _ in range(rng.randint(0, most)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(("", "a", " ", "x", "ll"))
            parts += ["".join(s), *rng.choice(([], ["and"], ["the", "license"]))]
        texts.append(" ".join(parts))
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        want = everywhere(text, notices)
        near = sorted((s["label"], s["first_word"], s["n_words"], s["edits"], s["matched"]) for s in r["near"])
        assert near == want, text
        base = brute(text)
        assert r["labels"] == ",".join(sorted({x[0] for x in want} | set(filter(None, base[4].split(","))))), text
        assert abs(r["score"] - (1.0 if base[1] else max((1 - d / len(t) for _, _, _, d, t in want), default=0.0))) < 1e-12, text


def test_edits_are_characters(spark):
    """Letters of two, three and four bytes are one edit each; notices may hold such letters themselves."""
    import random

    notices = [("all rights reserved", "proprietary", 1), ("mozilla public license", "mpl", 2), ("tous droits réservés", "droits", 1), ("保留所有权利 license", "hans", 2)]
    rng = random.Random(7)
    texts = ["all rïghts reserved", "mozilla püblìc license", "all rïghts resérved", "mozilla 公blic license", "m🙂zilla public licens", "Tous droits reservés", "保留所🙂权利 licence", "éé 东京 mozılla public license é"]
    for _ in range(60):
        notice, _, most = rng.choice(notices)
        s = list(notice)
        for _ in range(rng.randint(0, most + 1)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(("", "é", "东", "🙂", "権", "x"))
        texts.append(" ".join(rng.choice(("ñandú", "京", "the")) for _ in range(rng.randint(0, 3))) + " " + "".join(s) + " après")
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).collect()
    for r in rows:
        near = sorted((s["label"], s["first_word"], s["n_words"], s["edits"], s["matched"]) for s in r["near"])
        assert near == everywhere(texts[r["doc_id"]], notices), texts[r["doc_id"]]
    found = {r["doc_id"]: r["labels"] for r in rows}
    assert [found[i] for i in range(8)] == ["proprietary", "mpl", "", "mpl", "mpl", "droits", "hans", "mpl"]


def test_regex_and_table_agree():
    """The filter by edit distances passes over no end that the regex library matches."""
    import random

    rng = random.Random(2)
    for notice, label, most in licenses.NOTICES:
        own = licenses.Notice(notice, label, most)
        for _ in range(6):
            s = list(notice)
            for _ in range(rng.randint(0, most + 1)):
                s[rng.randrange(len(s))] = rng.choice("abx ")
            window = ("".join(s) + rng.choice(("", " v", " as"))).encode()
            ends = [i for i in range(1, len(window) + 1) if i == len(window) or window[i] == 32]
            assert licenses.ends_within(notice.encode(), window, most) == [e for e in ends if own.pattern.fullmatch(window, 0, e)]


def test_texts_full_of_seeds_take_linear_time():
    import time

    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    for unit, n in (("license ", 120_000), ("permission is hereby ", 45_000), ("gnu general public license ", 36_000), ("mozila public licens ", 45_000)):
        start = time.process_time()
        words, exact, near = scanner.scan(unit * n)
        assert time.process_time() - start < 30
        assert words == len(unit.split()) * n
        if "gnu" in unit:
            assert len(exact) == n and len([s for s in near if s[0] == "gpl"]) == n
        if "mozila" in unit:
            assert len(near) == n and all(s[2] == 3 and s[3] == 2 for s in near)


def test_odd_rows(spark, odd, none, clashing):
    rows = licenses.scan_licenses(clashing(odd)).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert (r["n_words"], r["n_base"]) == brute(by[r["doc_id"]])[:2]
    assert licenses.scan_licenses(none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
    short = sorted((r["n_words"], r["doc_id"]) for r in rows)[:30]  # every run of words against every notice is slow
    by = {r["doc_id"]: r for r in rows}
    for _, i in short + sorted((r["n_words"], r["doc_id"]) for r in rows if r["labels"] and r["n_words"] < 300)[:25]:
        near, base, r = everywhere(texts[i], licenses.NOTICES), brute(texts[i]), by[i]
        assert r["labels"] == ",".join(sorted({x[0] for x in near} | set(filter(None, base[4].split(",")))))
        assert abs(r["score"] - (1.0 if base[1] else max((1 - d / len(t) for _, _, _, d, t in near), default=0.0))) < 1e-12
