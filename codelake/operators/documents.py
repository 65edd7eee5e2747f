"""Documentation of symbols: cached, else generated, scored and refined where weak."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.text import cache_key, content_key, sanitize_code
from ..sources.cache import DocCache
from ..sources.providers import NullProvider, Provider, generate

# What the answers should look like.
CONTRACT = json.dumps({"summary": "", "params": [{"name": "", "type": "", "default": "", "desc": "", "optional": False}], "returns": {"type": "", "desc": ""}, "throws": [""], "examples": [{"title": "", "code": "", "description": ""}], "notes": [""], "performance": {"time_complexity": "", "space_complexity": "", "notes": ""}, "error_handling": {"strategy": "", "recovery": "", "logging": ""}})
SYSTEM = "You document source code. Answer with one JSON object and nothing else."


def prompt(language: Column, code: Column) -> Column:
    return F.concat(F.lit("Document this "), language, F.lit(" code as JSON of this form:\n" + CONTRACT + "\n\nCode:\n"), code)


def refinement(language: Column, code: Column, draft: Column, weak: Column) -> Column:
    return F.concat(F.lit("Improve these sections: "), F.array_join(weak, ", "), F.lit(".\nDraft:\n"), F.to_json(draft), F.lit("\n\n"), prompt(language, code))


def document(symbols: DataFrame, provider: Provider | None = None, cache: DocCache | None = None, calls_per_minute: float | None = None) -> DataFrame:
    """``symbols(language, code, ...)`` with details (DETAILS), docstring and from_cache.

    Without a provider all details are empty. Otherwise a snippet that the cache holds is looked up;
    others are generated once for each distinct snippet, scored, and asked for again where sections
    are weak, of which the better parts are kept. New details are appended to the cache."""
    keyed = symbols.withColumn("key", cache_key(F.col("language"), content_key(F.col("language"), F.col("code"))))
    if provider is None or isinstance(provider, NullProvider):
        out = keyed.withColumns({"details": quality.empty_details(), "from_cache": F.lit(False)})
        return out.withColumn("docstring", quality.docstring(F.col("details")))
    cache = cache or DocCache(symbols.sparkSession, None)
    known = cache.rows().select("key", F.from_json("details", quality.DETAILS).alias("details"))
    wanted = keyed.select("key", "language", "code").dropDuplicates(["key"])
    misses = wanted.join(known.select("key"), "key", "left_anti").withColumn("code", sanitize_code(F.col("code")))
    fresh = generated(misses, provider, calls_per_minute)
    from .graph import _cut

    fresh = _cut(fresh)  # a provider must not be asked again when the result is read twice
    cache.put(fresh.select("key", "language", F.to_json("details").alias("details")))
    details = known.withColumn("from_cache", F.lit(True)).unionByName(fresh.select("key", "details").withColumn("from_cache", F.lit(False)))
    out = keyed.join(details, "key", "left")
    return out.withColumn("docstring", quality.docstring(F.col("details")))


def generated(misses: DataFrame, provider: Provider, calls_per_minute: float | None = None) -> DataFrame:
    """key, language, details for ``misses(key, language, code)``: two passes at most."""
    from .graph import _cut

    asked = misses.select("key", prompt(F.col("language"), F.col("code")).alias("prompt"))
    answers = generate(asked, provider, system=SYSTEM, calls_per_minute=calls_per_minute).select("key", "answer", "error")
    empty = quality.empty_details()
    first = misses.join(answers, "key").withColumn("base", F.when(F.col("error").isNotNull(), empty).otherwise(quality.details_from(F.col("answer"))))
    first = _cut(first.select("key", "language", "code", "error", "base").withColumn("weak", quality.weak_sections(F.col("base"))))
    weak = first.filter((F.size("weak") > 0) & F.col("error").isNull())
    again = weak.select("key", refinement(F.col("language"), F.col("code"), F.col("base"), F.col("weak")).alias("prompt"))
    second = generate(again, provider, system=SYSTEM, calls_per_minute=calls_per_minute).select("key", quality.details_from(F.col("answer")).alias("refined"))
    both = first.join(second, "key", "left")
    merged = quality.merge_details(F.col("base"), F.col("refined")).cast(first.schema["base"].dataType)
    return both.select("key", "language", F.when(F.col("refined").isNull(), F.col("base")).otherwise(merged).alias("details"))
