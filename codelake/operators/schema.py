"""Validation and normal form of project documents.

A project row is ``{project_name, files: [{path, functions: [{name, description, parameters:
[{name, type, description}], returns: {type, description}}], classes: [{name, description,
methods: [function]}]}]}``. Documents that don't fit this type come as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands in for a missing part.
PROJECT, PATH, FUNCTION, CLASS = "Unnamed Project", "unknown", "unnamed", "UnnamedClass"
DESCRIPTION, PARAM_TYPE, PARAM_DESCRIPTION = "No description provided.", "any", "No description available."
RETURN_TYPE, RETURN_DESCRIPTION = "void", "No return value."

_PARAM = "struct<name:string,type:string,description:string>"
_FUNCTION = f"struct<name:string,description:string,parameters:array<{_PARAM}>,returns:struct<type:string,description:string>>"
_CLASS = f"struct<name:string,description:string,methods:array<{_FUNCTION}>>"
PROJECT_TYPE = f"struct<project_name:string,files:array<struct<path:string,functions:array<{_FUNCTION}>,classes:array<{_CLASS}>>>>"


def parse(json: Column) -> Column:
    """A project row from JSON; keys that the type lacks go, missing ones are null."""
    return F.from_json(json, PROJECT_TYPE)


def bad_function(f: Column) -> Column:
    """True if a name is missing, a parameter has none, or a return says neither type nor description."""
    params = F.exists(F.coalesce(f["parameters"], F.array().cast(f"array<{_PARAM}>")), lambda p: p["name"].isNull())
    returns = f["returns"].isNotNull() & f["returns"]["type"].isNull() & f["returns"]["description"].isNull()
    return f["name"].isNull() | params | returns


def missing_keys(json: Column, required: list[str]) -> Column:
    """Which of the required keys an object lacks, in their order."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def errors(json: Column) -> Column:
    """Why a document is invalid; empty if it is valid. Lists that are none, and missing keys."""
    files = parse(json)["files"]
    no_path = F.exists(files, lambda f: f["path"].isNull())
    wrong = lambda part: F.regexp_count(json, F.lit(rf'"{part}"\s*:\s*(?:"|\{{|-?\d|true|false)')) > 0
    return F.array_compact(
        F.array(
            F.when(F.try_parse_json(json).isNull(), F.lit("not JSON")),
            F.when(F.get_json_object(json, "$.project_name").isNull(), F.lit("project_name is missing")),
            F.when(F.get_json_object(json, "$.files").isNull(), F.lit("files is missing")),
            F.when(F.get_json_object(json, "$.files").isNotNull() & ~F.startswith(F.ltrim(F.get_json_object(json, "$.files")), F.lit("[")), F.lit("files is no list")),
            F.when(no_path, F.lit("a file has no path")),
            F.when(wrong("functions"), F.lit("functions is no list")),
            F.when(wrong("classes"), F.lit("classes is no list")),
        )
    )


def warnings(doc: Column) -> Column:
    """Names of functions and methods that are incomplete, over all files."""
    none = F.array().cast("array<string>")
    bad = lambda fs: F.coalesce(F.transform(F.filter(fs, bad_function), lambda f: F.coalesce(f["name"], F.lit(FUNCTION))), none)
    per_file = F.transform(doc["files"], lambda x: F.concat(bad(x["functions"]), F.coalesce(F.flatten(F.transform(x["classes"], lambda c: bad(c["methods"]))), none)))
    return F.coalesce(F.flatten(per_file), none)


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _function(f: Column) -> Column:
    params = F.transform(f["parameters"], lambda p: F.struct(_filled(p["name"], FUNCTION).alias("name"), _filled(p["type"], PARAM_TYPE).alias("type"), _filled(p["description"], PARAM_DESCRIPTION).alias("description")))
    returns = F.struct(_filled(f["returns"]["type"], RETURN_TYPE).alias("type"), _filled(f["returns"]["description"], RETURN_DESCRIPTION).alias("description"))
    return F.struct(_filled(f["name"], FUNCTION).alias("name"), _filled(f["description"], DESCRIPTION).alias("description"), F.coalesce(params, F.array().cast(f"array<{_PARAM}>")).alias("parameters"), returns.alias("returns"))


def normalize(doc: Column) -> Column:
    """A project row with every part filled in."""
    functions = lambda fs: F.coalesce(F.transform(fs, _function), F.array().cast(f"array<{_FUNCTION}>"))
    one_class = lambda c: F.struct(_filled(c["name"], CLASS).alias("name"), _filled(c["description"], DESCRIPTION).alias("description"), functions(c["methods"]).alias("methods"))
    classes = lambda cs: F.coalesce(F.transform(cs, one_class), F.array().cast(f"array<{_CLASS}>"))
    files = F.transform(doc["files"], lambda f: F.struct(_filled(f["path"], PATH).alias("path"), functions(f["functions"]).alias("functions"), classes(f["classes"]).alias("classes")))
    none = F.array().cast(f"array<struct<path:string,functions:array<{_FUNCTION}>,classes:array<{_CLASS}>>>")
    return F.struct(_filled(doc["project_name"], PROJECT).alias("project_name"), F.coalesce(files, none).alias("files"))
