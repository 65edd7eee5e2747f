"""Documentation details: their normal form, scores of their sections, and merges of two drafts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import SECTIONS, VAGUE_WORDS
from .text import contains_any, strip

PARAM = "struct<name:string,type:string,default:string,desc:string,optional:boolean>"
DETAILS = (
    f"summary string, params array<{PARAM}>, returns struct<type:string,desc:string>, throws array<string>,"
    " examples array<struct<title:string,code:string,description:string>>, notes array<string>,"
    " performance struct<time_complexity:string,space_complexity:string,notes:string>,"
    " error_handling struct<strategy:string,recovery:string,logging:string>"
)
#: Details when no provider is at hand.
EMPTY = {
    "summary": "", "params": [], "returns": {"type": "", "desc": ""}, "throws": [], "examples": [], "notes": [],
    "performance": {"time_complexity": "", "space_complexity": "", "notes": ""}, "error_handling": {"strategy": "", "recovery": "", "logging": ""},
}


def empty_details() -> Column:
    return F.from_json(F.lit(json.dumps(EMPTY)), DETAILS)


# --- normal form of free JSON (polymorphic, so in Python; used inside batched functions) ---

# The keys of an object that may hold its text, in order.
TEXT_KEYS = ("code", "text", "value", "summary", "desc", "description", "content")


def to_text(x) -> str:
    """Any JSON value as text: null is empty, objects give their first text key or JSON, lists a line each."""
    if x is None:
        return ""
    if isinstance(x, dict):
        held = [x[k] for k in TEXT_KEYS if x.get(k) is not None]
        return to_text(held[0]) if held else json.dumps(x, ensure_ascii=False)
    if isinstance(x, list):
        return "\n".join(map(to_text, x))
    return str(x)


def parse_param(x) -> dict:
    """A parameter from an object, or from ``name: type - description``."""
    if isinstance(x, dict):
        default = x.get("default")
        return {
            "name": to_text(x.get("name")).strip(),
            "type": to_text(x.get("type")).strip(),
            "default": None if default in (None, "", "None") else to_text(default),
            "desc": to_text(x.get("desc") or x.get("description")).strip(),
            "optional": bool(x.get("optional")),
        }
    name, _, rest = to_text(x).partition(":")
    kind, _, desc = rest.partition("-")
    return {"name": name.strip(), "type": kind.strip(), "default": None, "desc": desc.strip(), "optional": False}


def _listed(x) -> list:
    return [] if not x else x if isinstance(x, list) else [x]


def _fields(x, *names: str) -> dict:
    x = x if isinstance(x, dict) else {}
    return {n: to_text(x.get(n)).strip() for n in names}


def normalize_details(raw: dict) -> dict:
    """The normal form (see DETAILS) of an object that roughly follows it."""
    returns = raw.get("returns") or {}
    if isinstance(returns, dict):
        kind, desc = to_text(returns.get("type")).strip(), to_text(returns.get("desc") or returns.get("description")).strip()
    else:
        kind, _, desc = (p.strip() for p in to_text(returns).partition(" - "))
    texts = lambda name: [t for t in (to_text(v).strip() for v in _listed(raw.get(name))) if t]
    examples = []
    for e in _listed(raw.get("examples")):
        if isinstance(e, dict):
            examples.append({"title": to_text(e.get("title")).strip(), "code": to_text(e.get("code")).strip(), "description": to_text(e.get("description") or e.get("desc")).strip()})
        elif to_text(e).strip():
            examples.append({"title": "", "code": to_text(e).strip(), "description": ""})
    return {
        "summary": to_text(raw.get("summary")).strip(),
        "params": [parse_param(p) for p in _listed(raw.get("params")) if p is not None],
        "returns": {"type": kind, "desc": desc},
        "throws": texts("throws"),
        "examples": examples,
        "notes": texts("notes"),
        "performance": _fields(raw.get("performance"), "time_complexity", "space_complexity", "notes"),
        "error_handling": _fields(raw.get("error_handling"), "strategy", "recovery", "logging"),
    }


def parse_details(answer: str | None) -> dict:
    """Normal form of a provider's answer: JSON, JSON inside other text, or the text as summary."""
    answer = answer or ""
    for part in (answer, *re.findall(r"\{.*\}", answer, re.S)):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict):
            return normalize_details(got)
    return normalize_details({"summary": answer.strip()[:280]})


def details_from(answers: Column) -> Column:
    """:func:`parse_details` over a column, in batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(parse_details(t), ensure_ascii=False))

    return F.from_json(run(answers), DETAILS)


# --- scores, all by column expressions ---


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def score_summary(c: Column, vague: list[str] = VAGUE_WORDS) -> Column:
    """0.5, +0.3 without a vague word, +0.2 for 20 to 200 characters; 0 for none."""
    t = _text(c)
    clear = F.when(contains_any(F.lower(t), vague), 0.0).otherwise(0.3)
    fits = F.when(F.length(t).between(20, 200), 0.2).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.5) + clear + fits))


def score_params(c: Column) -> Column:
    """Mean over parameters: 0.9 for a description over 10 characters that isn't just the type or
    the name, 0.5 for another one, 0.1 for none."""

    def one(p: Column) -> Column:
        d = _text(p["desc"])
        low = F.lower(d)
        own = (low != F.lower(F.coalesce(p["type"], F.lit("")))) & (low != F.lower(F.coalesce(p["name"], F.lit(""))))
        return F.when((F.length(d) > 10) & own, 0.9).when(d != "", 0.5).otherwise(0.1)

    filled = F.exists(c, lambda p: (_text(p["name"]) != "") | (_text(p["type"]) != "") | (_text(p["desc"]) != ""))
    return F.when(F.coalesce(filled, F.lit(False)), _mean(F.transform(c, one))).otherwise(0.0)


def score_returns(c: Column) -> Column:
    d = _text(c["desc"])
    return F.when(_text(c["type"]) != "", 0.3).otherwise(0.0) + F.when(F.length(d) > 15, 0.7).when(d != "", 0.3).otherwise(0.0)


def score_examples(c: Column) -> Column:
    """Mean over examples: 1 for code over 20 and a description over 10 characters, 0.6 for code over 10, else 0.2."""
    code, desc = (lambda e: F.length(_text(e["code"]))), (lambda e: F.length(_text(e["description"])))
    filled = F.exists(c, lambda e: (code(e) > 0) | (desc(e) > 0) | (_text(e["title"]) != ""))
    one = lambda e: F.when((code(e) > 20) & (desc(e) > 10), 1.0).when(code(e) > 10, 0.6).otherwise(0.2)
    return F.when(F.coalesce(filled, F.lit(False)), _mean(F.transform(c, one))).otherwise(0.0)


def score_performance(c: Column) -> Column:
    big_o = lambda x: F.rlike(_text(x), F.lit(r"O\([^)]+\)"))
    return F.when(big_o(c["time_complexity"]), 0.4).otherwise(0.0) + F.when(big_o(c["space_complexity"]), 0.3).otherwise(0.0) + F.when(F.length(_text(c["notes"])) > 10, 0.3).otherwise(0.0)


def score_error_handling(c: Column) -> Column:
    """0.9 if the strategy names an error, or is over 20 characters and tries; 0.6 over 10 characters; 0.3 for any."""
    s = _text(c["strategy"])
    named = ((F.length(s) > 20) & F.contains(F.lower(s), F.lit("try"))) | F.contains(F.lower(s), F.lit("error"))
    return F.when(named, 0.9).when(F.length(s) > 10, 0.6).when(s != "", 0.3).otherwise(0.0)


def _any_text(c: Column) -> Column:
    return F.coalesce(F.exists(c, lambda t: _text(t) != ""), F.lit(False))


def score_throws(c: Column) -> Column:
    """0 for none, 0.9 if one names a special exception, else 0.5."""
    special = F.exists(c, lambda t: F.contains(F.coalesce(t, F.lit("")), F.lit("Exception")) & (_text(t) != "Exception"))
    return F.when(~_any_text(c), 0.0).when(special, 0.9).otherwise(0.5)


def score_notes(c: Column) -> Column:
    length = _mean(F.transform(c, lambda t: F.length(_text(t)).cast("double")))
    return F.when(~_any_text(c), 0.0).when(length > 20, 0.9).otherwise(0.6)


SCORES = dict(zip(SECTIONS, (score_summary, score_params, score_returns, score_examples, score_performance, score_error_handling, score_throws, score_notes), strict=True))


def score_sections(details: Column) -> Column:
    """A struct of the eight section scores."""
    return F.struct(*[F.coalesce(SCORES[s](details[s]), F.lit(0.0)).alias(s) for s in SECTIONS])


def weak_sections(details: Column, threshold: float = 0.6) -> Column:
    """Names of the sections that score below the threshold, in the order of SECTIONS."""
    scores = score_sections(details)
    return F.array_compact(F.array(*[F.when(scores[s] < threshold, F.lit(s)) for s in SECTIONS]))


def has_content(details: Column, section: str) -> Column:
    """True if some text of the section isn't blank."""
    c = details[section]
    if section == "summary":
        return _text(c) != ""
    if section in ("throws", "notes"):
        return _any_text(c)
    if section in ("params", "examples"):
        names = ("name", "type", "desc") if section == "params" else ("title", "code", "description")
        return F.coalesce(F.exists(c, lambda e: F.concat(*[_text(e[n]) for n in names]) != ""), F.lit(False))
    names = {"returns": ("type", "desc"), "performance": ("time_complexity", "space_complexity", "notes"), "error_handling": ("strategy", "recovery", "logging")}[section]
    return F.concat(*[_text(c[n]) for n in names]) != ""


def merge_params(base: Column, refined: Column) -> Column:
    """Full outer join of two parameter arrays by name, inside the row.

    One that both have is the refined one if its description is over 1.2 times as long, else the base
    one. Blank names go. If an array is empty, the other is returned as it is. Sorted by name."""
    named = lambda c: F.filter(c, lambda p: _text(p["name"]) != "")
    last = lambda c, n: F.element_at(F.filter(c, lambda q: q["name"] == n), -1)
    names = F.array_sort(F.array_union(F.transform(named(base), lambda p: p["name"]), F.transform(named(refined), lambda p: p["name"])))
    size = lambda p: F.length(_text(p["desc"]))

    def pick(n: Column) -> Column:
        has_b, has_r = F.exists(base, lambda p: p["name"] == n), F.exists(refined, lambda p: p["name"] == n)
        b, r = F.when(has_b, last(base, n)), F.when(has_r, last(refined, n))
        return F.when(has_b & has_r, F.when(size(r) > 1.2 * size(b), r).otherwise(b)).otherwise(F.coalesce(b, r))

    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return F.when(empty(base), refined).when(empty(refined), base).otherwise(F.transform(names, pick))


def merge_details(base: Column, refined: Column, margin: float = 0.1) -> Column:
    """The better draft of each section: one that scores more by the margin; else the refined one if
    it has content. Parameters are merged one by one."""
    sb, sr = score_sections(base), score_sections(refined)
    out = []
    for s in EMPTY:  # the order of DETAILS
        if s == "params":
            out.append(merge_params(base[s], refined[s]).alias(s))
        else:
            better = (sr[s] > sb[s] + margin) | (~(sb[s] > sr[s] + margin) & has_content(refined, s))
            out.append(F.when(better, refined[s]).otherwise(base[s]).alias(s))
    return F.struct(*out)


def docstring(d: Column) -> Column:
    """A docstring with Args, Returns, Raises and at most two Examples."""

    def arg(p: Column) -> Column:
        value = F.coalesce(p["default"], F.lit("None"))
        more = F.coalesce(p["optional"], F.lit(False)) | (~F.coalesce(p["default"], F.lit("")).isin("", "None"))
        extra = F.when(more, F.concat(F.lit(" (optional, default="), value, F.lit(")"))).otherwise("")
        return F.rtrim(F.concat(F.lit("    "), _text(p["name"]), F.lit(" ("), _text(p["type"]), F.lit("): "), _text(p["desc"]), extra))

    def block(title: str, lines: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"\n{title}:\n"), F.array_join(lines, "\n")))

    pad = lambda t: F.concat(F.lit("    "), _text(t))
    returns = F.array(F.rtrim(F.concat(F.lit("    "), _text(d["returns"]["type"]), F.lit(": "), _text(d["returns"]["desc"]))))
    text = F.concat_ws(
        "\n",
        F.when(_text(d["summary"]) != "", _text(d["summary"])),
        block("Args", F.transform(d["params"], arg), F.size(d["params"]) > 0),
        block("Returns", returns, F.concat(_text(d["returns"]["type"]), _text(d["returns"]["desc"])) != ""),
        block("Raises", F.transform(d["throws"], pad), F.size(d["throws"]) > 0),
        block("Examples", F.transform(F.slice(d["examples"], 1, 2), lambda e: pad(F.coalesce(e["code"], e["description"]))), F.size(d["examples"]) > 0),
    )
    return F.when(strip(text) == "", "No documentation available.").otherwise(strip(text))
