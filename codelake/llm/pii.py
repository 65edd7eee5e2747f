"""Personal data replaced by keyed surrogates.

Entities are found by patterns; names by a form of address, or by a known given name before
other capitalised words. What is replaced is an entity's plain value: a number without its
separators, an address in lower case, each given and family name by itself, without the title. Each
distinct (kind, value) gets a surrogate from an HMAC stream, which takes the form of each place:
its separators, its case. Kinds, scripts and genders stay, as do valid check digits. So one value
has one surrogate in all documents, however it is written, and ``Mr John Smith``, ``JOHN SMITH`` and
``Mr. Smith`` stay one person. Two values never share one: surrogates are compared over the whole
corpus, and with the values that really occur, and all but one of a clash draw again. A given name has
one gender in the whole corpus: that which most of its forms of address, or the lists, tell.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

# Given names by gender and family names, by script.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sophie Emma Clara Elena Lucia Marta Alice Nina Eva Ida Lena Paula Rosa Vera Irene Nora".split(),
    ("m", "latin"): "Paul Peter Martin Thomas David Daniel Simon Lukas Felix Oscar Victor Hugo Marco Leon Adam Emil Anton Max Karl Bruno".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Юлия Вера Нина".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Павел Михаил Олег".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Ειρήνη Δήμητρα Ιωάννα Χριστίνα Βασιλική".split(),
    ("m", "greek"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Πέτρος Παύλος Ανδρέας Σπύρος Μιχάλης".split(),
}
FAMILY = {
    "latin": "Adler Berger Costa Dumont Ellis Fischer Garcia Hansen Ivers Jansen Keller Lambert Moreau Navarro Olsen Perez Quinn Rossi Silva Torres Ulmer Vidal Weber Young Zeller".split(),
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Соколов Лебедев Новиков Морозов".split(),
    "greek": "Παπαδόπουλος Παππάς Νικολάου Γεωργίου Οικονόμου Δημητρίου Ιωάννου Βασιλείου Αντωνίου Κωνσταντίνου".split(),
}
# More given names that are known without a form of address, by gender.
KNOWN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Hannah Charlotte Olivia Amelia Katharina Ursula Sabine Monika Camille Isabelle Carmen Lucía Sofía Ann Anne Jane Kate Светлана Екатерина Γεωργία Αικατερίνη".split(),
    "m": "John James Robert Michael William Richard Joseph Charles Christopher Matthew Anthony Mark Steven Andrew Kenneth George Edward Brian Kevin Jason Jeffrey Ryan Jacob Eric Jonathan Stephen Henry Jack Hans Jürgen Wolfgang Klaus Stefan Pierre Louis Jean Jacques Philippe Carlos José Juan Miguel Javier Pablo Владимир Александр Γεώργιος Ιωάννης".split(),
}
# Forms of address by the gender that they tell (n: none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n", "Κύριος": "m", "Κυρία": "f", "Κος": "m", "Господин": "m", "Госпожа": "f"}
LOWER_TITLES = {"господин": "m", "госпожа": "f", "monsieur": "m", "madame": "f", "señor": "m", "señora": "f", "κύριος": "m", "κύριο": "m", "κυρία": "f", "κος": "m"}
# Patterns by kind, tried in this order where they start at one place. Repeats are
# bounded or possessive, so that a text without white space takes linear time.
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs)_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])(?:\d{4}[ -]){3}\d{1,7}(?![\d-])|(?<![\d.-])\d{13,19}(?![\d-])"),
    ("phone", r"\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]?\d{2,4}){1,4}(?!\d)|(?<![\d+])\(\d{3}\)\s?\d{3}[\s.-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.,:/+-])0\d{2,4}[ /-]\d{5,8}(?![\d.,:-])"),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
# A text without one of these cannot hold any entity but names, and is passed by quickly: every match of a pattern has one.
_HINT = re.compile(r"@|\d\d|\d\.\d|[0-9a-fA-F]:|sk-|gh[pos]_|AKIA|ASIA|[0-9a-f]{32}|[0-9A-F]{32}")
_UPPER = "A-ZÀ-ÖØ-ÞĄĆČĎĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽΆΈ-ΏΑ-ΫЀ-Я"
_WORD = rf"[{_UPPER}][\w'’-]*+"
_RUN = re.compile(rf"[{_UPPER}](?<!\w\w)[\w'’-]*+(?:\.? {_WORD})++")
_LED = re.compile(rf"(?<!\w)({'|'.join(LOWER_TITLES)})\.? ({_WORD}(?: {_WORD})*+)")
_TITLE = {**TITLES, **{t.upper(): g for t, g in TITLES.items()}}
_GENDER = {n.lower(): g for (g, _), names in GIVEN.items() for n in names} | {n.lower(): g for g, names in KNOWN.items() for n in names}
PART = "struct<start:int,length:int,entity:int,kind:string,value:string>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def plain(kind: str, text: str) -> str | None:
    """The value of an entity, however it is written; None if it is no such entity."""
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(text).exploded.replace(":", "") if len(re.findall("[0-9A-Fa-f]+", text)) > 1 else None
        except ValueError:
            return None
    if kind in ("ssn", "card", "mac", "iban", "phone"):
        bare = "".join(c for c in text if c.isalnum())
        return bare.lower() if kind == "mac" else "+" + bare if text[0] == "+" else bare
    return text.lower() if kind in ("email", "family") or kind.startswith("given") else text


def _name_parts(words: list[tuple[int, str]], gender: str | None) -> list[tuple[int, str, str]]:
    """(start, word, kind) of the name at the beginning of capitalised words; ``gender``: that of
    the form of address before it, None without one, where only a known given name begins a name."""
    known = [_GENDER.get(w.lower()) for _, w in words[:3]]
    if gender is None and (not known[0] or len(words) < 2):
        return []
    n = min(len(words), 3 if len(words) > 2 and (known[1] or len(words[1][1]) == 1) else 2)
    if n == 1:
        return [(*words[0], f"given-{known[0]}" if known[0] else "family")]
    return [(s, w, f"given-{g or gender or 'n'}") for (s, w), g in zip(words[: n - 1], known, strict=False)] + [(*words[n - 1], "family")]


def _names(text: str) -> list[list[tuple[int, str, str]]]:
    out = []
    for m in _RUN.finditer(text):
        words = [(m.start() + w.start(), w.group()) for w in re.finditer(r"[^ .]+", m.group())]
        k = 0
        while k < len(words):
            title = _TITLE.get(words[k][1])
            stop = next((j for j in range(k + 1, min(k + 4, len(words))) if words[j][1] in _TITLE), min(k + 4, len(words)))
            own = _name_parts(words[k + 1 : stop], title) if title and stop > k + 1 else [] if title else _name_parts(words[k:stop], None)
            if own:
                out.append(own)
            k += max(1, len(own) + bool(title))
    if any(t in text for t in LOWER_TITLES):
        for m in _LED.finditer(text):
            words = [(m.start(2) + w.start(), w.group()) for w in re.finditer(r"[^ ]+", m.group(2))]
            out.append(_name_parts(words, LOWER_TITLES[m.group(1)]))
    return out


def detect(text: str | None) -> list[tuple[int, int, int, str, str]]:
    """(start, length, entity, kind, value) of each part of an entity, in code points, from left to
    right. Names have a part for each word; all other entities have one."""
    if not text:
        return []
    found = []
    if _HINT.search(text):
        for m in _ANY.finditer(text):
            value = plain(m.lastgroup, m.group())
            if value is not None:
                found.append([(m.start(), m.group(), m.lastgroup, value)])
    held = {}  # names give way to other entities, and to names found before them
    for group in [*found, *([(s, w, k, plain(k, w)) for s, w, k in own] for own in _names(text))]:
        if not any(held.get(s) or held.get(s + len(w) - 1) for s, w, _, _ in group):
            for s, w, _, _ in group:
                held[s] = held[s + len(w) - 1] = group
    groups = sorted({id(g): g for g in held.values()}.values(), key=lambda g: g[0][0])
    return [(s, len(w), e, k, v) for e, group in enumerate(groups) for s, w, k, v in group]


class Draw:
    """Numbers from HMAC-SHA256 of (kind, value, counter)."""

    def __init__(self, key: bytes, *parts):
        self.key, self.parts, self.n, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hmac.new(self.key, self.parts + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        head, self.left = self.left[:8], self.left[8:]
        return int.from_bytes(head, "big") % n


def _like(value: str, draw: Draw, keep: int = 0) -> str:
    """Digits for digits and letters for letters of the same case and script, after ``keep`` characters."""
    out = list(value[:keep])
    for c in value[keep:]:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr((97 if c.islower() else 65) + draw.below(26)))
        elif c.isalpha():
            first, last = ("а", "я") if "а" <= c.lower() <= "я" else ("α", "ω") if "α" <= c.lower() <= "ω" else ("à", "ö")
            d = chr(ord(first) + draw.below(ord(last) - ord(first) + 1))
            out.append(d if c.islower() else d.upper())
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, turn: int = 0) -> str:
    """The ``turn``-th stand-in for a value of :func:`plain`, itself such a value."""
    draw = Draw(key, kind, value, turn)
    pick = lambda items: items[draw.below(len(items))]
    if kind == "family" or kind.startswith("given"):
        script = "cyrillic" if re.search("[Ѐ-ӿ]", value) else "greek" if re.search("[Ͱ-Ͽ]", value) else "latin"
        names = FAMILY[script] if kind == "family" else GIVEN["fm"[draw.below(2)] if kind == "given-n" else kind[-1], script]
        parts = [pick(names), *([pick(names)] if turn else [])]  # the lists are short: a second name makes room
        if turn > 8:
            parts[-1] += _like({"latin": "aaaa", "cyrillic": "аааа", "greek": "αααα"}[script], draw)
        if kind == "family" and script == "cyrillic" and value.endswith("а"):
            parts = [x + "а" if x.endswith("в") else x for x in parts]
        return "-".join(parts).lower()
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local, draw)}@{_like(host, draw)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind in ("mac", "ip6"):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    if kind == "secret":
        lead = re.match(r"AKIA|ASIA|gh[pos]_|sk-", value)
        if lead:
            return _like(value, draw, keep=lead.end())
        return "".join(("0123456789abcdef" if value.islower() or value.isdigit() else "0123456789ABCDEF")[draw.below(16)] for _ in value)
    if kind == "iban":
        made = _like(value, draw, keep=2)
        return made[:2] + f"{98 - _mod97(made[:2] + '00' + made[4:]):02d}" + made[4:] if _mod97(value) == 1 else made
    if kind == "phone":  # a country code of one or two digits, or the leading 0, stays
        return _like(value, draw, keep=(2 if value[1] in "17" else 3) if value[0] == "+" else 1 if value[0] == "0" else 0)
    made = _like(value, draw)
    if kind == "card" and luhn(value):
        made = next(m for m in (made[:-1] + d for d in "0123456789") if luhn(m))
    return made


def render(kind: str, text: str, made: str) -> str:
    """A surrogate in the form of the place that it replaces."""
    if kind in ("ssn", "card", "iban", "phone", "mac"):
        own = iter(made.lstrip("+"))
        filled = "".join(next(own) if c.isalnum() else c for c in text)
        return filled.upper() if kind == "mac" and text.upper() == text else filled
    if kind == "ip6":
        short = str(ipaddress.IPv6Address(int(made, 16)))
        return short.upper() if text.upper() == text else short
    if kind == "email":
        return made.upper() if text.upper() == text else made[0].upper() + made[1:] if text[0].isupper() else made
    if kind == "family" or kind.startswith("given"):
        return made.upper() if len(text) > 1 and text.upper() == text else "-".join(x.capitalize() for x in made.split("-"))
    return made


def _scan(batches):
    from pyspark import TaskContext

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("entity", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    names, row = ("start", "length", "entity", "kind", "value"), TaskContext.get().partitionId() << 33
    for b in batches:
        parts = [[dict(zip(names, p, strict=True)) for p in detect(t.as_py())] for t in b.column(1)]
        rows, row = pa.array(range(row, row + len(parts)), pa.int64()), row + len(parts)
        yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(1), pa.array([len(p) for p in parts], pa.int32()), pa.array(parts, kind)], names=["row", "doc_id", "text", "n", "parts"])


def replaced(text: str, parts: list[dict]) -> tuple[list[dict], str]:
    """Spans (start, length, kind, surrogate) of the entities, and the text with them replaced."""
    out, spans, at = [], [], 0
    for p in sorted(parts, key=lambda p: p["start"]):
        start, end, kind = p["start"], p["start"] + p["length"], p["kind"]
        made = render(kind, text[start:end], p["surrogate"])
        out += [text[at:start], made]
        if spans and spans[-1]["entity"] == p["entity"]:  # a further word of a name
            spans[-1]["surrogate"] += text[at:start] + made
            spans[-1]["length"] = end - spans[-1]["start"]
        else:
            spans.append({"entity": p["entity"], "start": start, "length": end - start, "kind": "name" if kind == "family" or kind.startswith("given") else kind, "surrogate": made})
        at = end
    return spans, "".join([*out, text[at:]])


def _replace(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
    for b in batches:
        done = [replaced(t.as_py(), p.as_py()) for t, p in zip(b.column(1), b.column(2), strict=True)]
        spans = pa.array([[{k: v for k, v in s.items() if k != "entity"} for s in spans] for spans, _ in done], kind)
        yield pa.RecordBatch.from_arrays([b.column(0), spans, pa.array([t for _, t in done], pa.string())], names=["doc_id", "spans", "text"])


def assign(entities: DataFrame, key: bytes, max_turns: int = 40) -> DataFrame:
    """kind, value, surrogate for distinct rows of (kind, value, gender), without clashes.

    In each turn all open values draw; a draw is taken if it is no real value of the corpus and
    not taken before, by the smallest value that drew it. Given and family names are one space here:
    no name stands for two, and none for a name that occurs."""
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("space")
    own = entities.select(space, "kind", "value", "gender")
    real = own.select("space", F.col("value").alias("surrogate")).distinct()

    def drawn(turn: int):
        def run(batches):
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("kind", "value", "gender")), strict=True)
                made = [surrogate(key, f"given-{g}" if k == "given" else k, v, turn) for k, v, g in rows]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("space", "kind", "value")), pa.array(made, pa.string())], names=["space", "kind", "value", "surrogate"])

        return run

    taken, left = None, own
    for turn in range(max_turns):
        tried = left.mapInArrow(drawn(turn), "space string, kind string, value string, surrogate string")
        tried = tried.join(real, ["space", "surrogate"], "left_anti")
        if taken is not None:
            tried = tried.join(taken.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = materialize(tried.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "value")).alias("v")).select("space", "v.kind", "v.value", "surrogate"), "surrogates")
        taken = won if taken is None else taken.unionByName(won)
        left = materialize(left.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "open-entities")
        if not left.take(1):
            return taken.drop("space")
    raise RuntimeError("some entities found no free surrogate; widen the formats or the name lists")


def _looked_up(parts: DataFrame, names: DataFrame, counts: DataFrame) -> DataFrame:
    """``parts`` with their surrogates. Values of a 128th of all parts or more, 128 of them at most,
    are sent to the parts, so that no task gets all parts of a value that very many documents hold."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") >= max(1000, total // 128)).select("kind", "value")
    hot = F.broadcast(names.join(F.broadcast(often), ["kind", "value"]).withColumnRenamed("surrogate", "known"))
    parts = parts.join(hot, ["kind", "value"], "left")
    rest = parts.filter("known is null").drop("known").join(names, ["kind", "value"])
    return rest.unionByName(parts.filter("known is not null").withColumnRenamed("known", "surrogate"))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs(doc_id, text)`` with surrogates for personal data; one row for each row.

    Columns: doc_id, n_entities, kinds (distinct, sorted, comma-joined), spans (array of start,
    length, kind, surrogate; places are code points of the original text), text (replaced).
    Equal values get equal surrogates everywhere, different ones different surrogates, and no
    surrogate is a value that really occurs; given and family names count together in this. ``key`` decides all draws; who knows it can tell
    which surrogate a guessed value has, so it is to be kept secret.

    Null text: null text, no entities. Empty text: stays. Null doc_id: handled like others.
    Repeated rows: equal results. No rows: none. Further columns are ignored."""
    if not key:
        raise ValueError("an empty key gives no protection")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, f"row long, doc_id long, text string, n int, parts array<{PART}>"), "scanned")
    parts = scanned.filter("n > 0").select("row", F.inline("parts"))
    # a given name is one value whatever stands before it; its gender is what most of its places tell
    given = F.startswith("kind", F.lit("given"))
    parts = parts.withColumns({"gender": F.when(given, F.substring("kind", -1, 1)), "kind": F.when(given, "given").otherwise(F.col("kind"))})
    tells = lambda g: F.count_if(F.col("gender") == g)
    counts = parts.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), tells("m").alias("m"), tells("f").alias("f"))
    gender = F.when((F.col("m") > 0) & (F.col("m") >= F.col("f")), "m").when(F.col("f") > 0, "f").otherwise("n")
    counts = materialize(counts.select("kind", "value", "n", gender.alias("gender")), "entities")
    named = _looked_up(parts, assign(counts, key), counts)
    named = named.groupBy("row").agg(F.collect_list(F.struct("start", "length", "entity", "kind", "surrogate")).alias("parts"))
    dirty = scanned.filter("n > 0").select("row", "doc_id", "text").join(named, "row").select("doc_id", "text", "parts")
    spans = "array<struct<start:int,length:int,kind:string,surrogate:string>>"
    dirty = dirty.mapInArrow(_replace, f"doc_id long, spans {spans}, text string")
    clean = scanned.filter("n = 0").select("doc_id", F.array().cast(spans).alias("spans"), "text")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",")
    return clean.unionByName(dirty).select("doc_id", F.size("spans").cast("long").alias("n_entities"), kinds.alias("kinds"), "spans", "text")
