"""Relevance of a match as one integer column, a sum of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .rules import starts

# How lines that define types and functions begin, and path parts of fixtures and samples.
TYPE_LINES = ("struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "interface ", "export interface ", "type ", "export type ", "class ", "export class ", "impl ")
FUNCTION_LINES = ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "function ", "export function ", "export default function ", "export async function ")
FIXTURE_DIRS = ("mock", "mocks", "fixture", "fixtures", "stub", "stubs", "fake", "fakes", "example", "examples")
SAMPLE_DIRS = ("example", "examples", "sample", "samples", "template", "templates")
HASH_COMMENTS = ("py", "rb", "sh", "bash", "zsh", "yaml", "yml", "toml", "pl", "r", "R")


def parts_in(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def proximity(path: Column) -> Column:
    """200, less 20 for each path component."""
    return F.greatest(F.lit(0), 200 - 20 * F.size(F.split(path, "/")))


def basename_boost(path: Column, q: str) -> Column:
    stem = F.lower(F.regexp_replace(T.basename(path), r"(?<=.)\.[^.]*$", ""))
    low = F.lit(q.lower())
    parent = F.lower(T.basename(T.dirname(path)))
    return (
        F.when(stem == low, 500).when(F.startswith(stem, low) & F.substring(stem, len(q) + 1, 1).isin("_", ".", "-"), 350)
        .when(F.endswith(stem, low), 250).when(F.contains(stem, low), 180).when(parent == low, 200).otherwise(0)
    )


def intent_boost(text: Column, q: str) -> Column:
    t = F.ltrim(text)
    if q[:1].isupper():
        return F.when(starts(t, TYPE_LINES), 90).otherwise(0)
    return F.when(starts(t, FUNCTION_LINES), 70).otherwise(0) if q[:1].islower() else F.lit(0)


def exported_boost(text: Column) -> Column:
    t = F.ltrim(text)
    return F.when(F.startswith(t, F.lit("export default ")), 90).when(F.startswith(t, F.lit("export ")), 75).when(F.startswith(t, F.lit("pub ")), 60).otherwise(0)


def name_boost(name: Column, impl_target: Column, q: str) -> Column:
    low, query = F.lower(name), F.lit(q.lower())
    found = F.when(name == q, 220).when(low == query, 180).when(impl_target == q, 120).when(F.startswith(low, query), 80).when(F.contains(low, query), 40)
    return F.coalesce(F.when(name.isNotNull(), found), F.lit(0))


def words_boost(path: Column, text: Column, q: str) -> Column:
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in q.lower()).split()]
    if " " not in q or len(words) < 2:
        return F.lit(0)
    hay = F.split(F.lower(F.concat_ws(" ", path, text)), r"[^\p{L}\p{N}_]+")
    n = reduce(lambda a, b: a + b, [F.array_contains(hay, w).cast("int") for w in words])
    return F.when(n == len(words), 300).when(n >= len(words) - 1, 120).otherwise(0)


def non_code_penalty(path: Column) -> Column:
    sample = parts_in(path, SAMPLE_DIRS) & T.extension(path).isin("md", "txt", "rst")
    return F.when(T.is_doc_path(path), 250).otherwise(0) + F.when(sample, 80).otherwise(0) + F.when(F.contains(path, F.lit("generated")), 150).otherwise(0)


def incidental_penalty(text: Column, path: Column, is_definition: Column, q: str) -> Column:
    t = F.trim(text)
    comment = (F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("///"))) | starts(t, ("/*", "<!--")) | (F.startswith(t, F.lit("#")) & T.extension(path).isin(*HASH_COMMENTS))
    low = F.lower(t)
    at = F.instr(low, "//")
    trailing = (at > 1) & (F.substr(low, F.greatest(at - 1, F.lit(1)), F.lit(1)) != ":") & F.contains(F.substr(low, F.greatest(at, F.lit(1))), F.lit(q.lower())) & ~F.contains(F.substr(low, F.lit(1), at - 1), F.lit(q.lower()))
    return F.when(is_definition, 0).when(comment, 150).when(trailing, 100).otherwise(0)


def context_boost(path: Column, context: str | None, package: Column | None = None, context_package: str | None = None) -> Column:
    if context is None:
        return F.lit(0)
    home = T.dirname(F.lit(context))
    near = F.when(T.dirname(path) == home, 100).when(T.shared_depth(path, F.lit(context)) >= 2, 40).otherwise(0)
    return near if package is None or context_package is None else near + F.when(package == context_package, 75).otherwise(0)


def score(m: dict[str, Column], q: str, now: Column | None = None, context: str | None = None) -> Column:
    """m: path, text, is_definition, def_weight, def_name, impl_target, exact, file_lines, mtime; all but path and text may be missing."""
    false, zero, none = F.lit(False), F.lit(0), F.lit(None).cast("string")
    get = lambda k, d: m.get(k, d)
    path, text, is_def = m["path"], m["text"], get("is_definition", false)
    testing = any(x in q.lower() for x in ("test", "spec")) or q.lower().startswith("should")
    terms = [
        F.when(is_def, 10 * get("def_weight", zero)).otherwise(0),
        name_boost(get("def_name", none), get("impl_target", none), q) if "def_name" in m else zero,
        F.when(get("exact", false), 500).otherwise(0),
        intent_boost(text, q), words_boost(path, text, q), proximity(path),
        T.recency(m["mtime"], now) if "mtime" in m and now is not None else zero,
        F.when((get("file_lines", zero) > 0) & (get("file_lines", zero) < 200), 50).otherwise(0),
        context_boost(path, context), basename_boost(path, q), exported_boost(text),
        -non_code_penalty(path), -incidental_penalty(text, path, is_def, q),
        zero if testing else -F.when(T.is_test_path(path), 120).otherwise(0),
        -F.when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, FIXTURE_DIRS))), 90).otherwise(0),
        -F.when(T.is_vendor_path(path), 200).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, terms).cast("long")


def stratum(is_definition: Column, weight: Column) -> Column:
    """0 for code definitions, 1 for soft ones, 2 for usages."""
    return F.when(~is_definition, 2).when(weight >= 60, 0).otherwise(1)
