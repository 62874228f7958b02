"""Searches over lines and definitions: literal, regex, usage, relaxed words, symbols, facets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions import text as T

MATCHES, ALL_MATCHES, FACETS_FROM = 10, 100, 5


def checked(pattern: str) -> str:
    """Rejects look-around and back references, which matching in linear time has not."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern}")
    return pattern


def literal(rows: DataFrame, q: str) -> DataFrame:
    return rows.where(F.contains("text", F.lit(q)))


def regex(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(F.col("text").rlike(checked(pattern)))


def usages(rows: DataFrame, name: str) -> DataFrame:
    """Lines with the name as a whole word; the cheap substring test comes first."""
    return rows.where(F.contains("text", F.lit(name))).where(T.whole_word(F.col("text"), name))


def relaxed(rows: DataFrame, q: str) -> DataFrame:
    """Two words: both on a line, in either order; more: any of them."""
    words = q.split()
    found = [F.contains("text", F.lit(w)) for w in words]
    if len(words) == 2:
        a, b = map(T.quoted, words)
        return rows.where(found[0] & found[1] & F.col("text").rlike(f"{a}.*{b}|{b}.*{a}"))
    return rows.where(reduce(lambda x, y: x | y, found))


def exists(rows: DataFrame, name: str) -> bool:
    """Whether the name is anywhere."""
    return not literal(rows, name).limit(1).isEmpty()


def without_definitions(used: DataFrame, defined: DataFrame) -> DataFrame:
    """Usages that are on no definition's line."""
    return used.join(defined.select("path", "line").distinct(), ["path", "line"], "left_anti")


def distinct_definitions(definitions: DataFrame) -> DataFrame:
    """Each definition once: equal in file, line, span, name and the type that it implements."""
    return definitions.dropDuplicates(["path", "line", "start_line", "end_line", "def_name", "impl_target"])


def symbol_matches(definitions: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Definitions of a name, and its usages elsewhere: path, line, text, is_definition, def_weight, def_name."""
    own = definitions.where(F.col("def_name") == name)
    own = own.select("path", "line", "text", F.lit(True).alias("is_definition"), "def_weight", "def_name")
    used = without_definitions(usages(rows, name), own)
    used = used.select("path", "line", "text", F.lit(False).alias("is_definition"), F.lit(0).alias("def_weight"), F.lit(None).cast("string").alias("def_name"))
    return own.unionByName(used)


def ranked(matches: DataFrame, q: str, now: Column | None = None, context: str | None = None) -> DataFrame:
    """Adds score and stratum."""
    have = {c: F.col(c) for c in matches.columns}
    out = matches.withColumn("score", ranking.score(have, q, now, context))
    weight = F.col("def_weight") if "def_weight" in have else F.lit(0)
    return out.withColumn("stratum", ranking.stratum(F.col("is_definition"), weight)) if "is_definition" in have else out.withColumn("stratum", F.lit(2))


def top(matches: DataFrame, n: int | None = MATCHES) -> DataFrame:
    """The n first by stratum, score, path, line; all for None."""
    first = matches.orderBy("stratum", F.desc("score"), "path", "line")
    return first if n is None else first.limit(n)


def facet(path: Column, text: Column, is_definition: Column, package: Column, home: str | None) -> Column:
    """definition, test, local (the package of the first definition) or other usage."""
    local = F.lit(False) if home is None else package == home
    return F.when(is_definition, "definition").when(T.is_test_facet(path, text), "test").when(local, "usage_local").otherwise("usage_cross")


def totals(matches: DataFrame) -> DataFrame:
    """total, definitions and usages, before any cap."""
    return matches.agg(F.count("*").alias("total"), F.count_if("is_definition").alias("definitions"), F.count_if(~F.col("is_definition")).alias("usages"))


def many(rows: DataFrame, names: list[str], n: int = MATCHES) -> DataFrame:
    """Whole-word matches of two to five names in one scan: q_idx, q, path, line, text, nth, the n first of each by score, path, line."""
    hits = [F.when(F.contains("text", F.lit(q)) & T.whole_word(F.col("text"), q), F.struct(F.lit(i).alias("q_idx"), F.lit(q).alias("q"), ranking.score({"path": F.col("path"), "text": F.col("text")}, q).alias("score"))) for i, q in enumerate(names)]
    found = rows.select("path", "line", "text", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*", "path", "line", "text")
    nth = F.row_number().over(Window.partitionBy("q_idx").orderBy(F.desc("score"), "path", "line"))
    return found.withColumn("nth", nth).where(F.col("nth") <= n)


def did_you_mean(names: DataFrame, name: str, q: str, most: int = 3, n: int = 1) -> DataFrame:
    """Names within an edit distance of the query, nearest first."""
    near = names.withColumn("distance", F.levenshtein(F.col(name), F.lit(q), most)).where("distance >= 0")
    return near.orderBy("distance", name).limit(n)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ** crosses directories, {a,b} alternates."""
    out, at, depth = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            at = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += T.quoted(c)
        at += 1
    return f"^{out}$"


def glob(files: DataFrame, pattern: str, n: int = 20) -> DataFrame:
    """Files whose name or path matches; a leading ! negates; the n first by path."""
    negate = pattern.startswith("!")
    p = glob_pattern(pattern.removeprefix("!"))
    hit = F.col("path").rlike(p) | T.basename(F.col("path")).rlike(p)
    return files.where(~hit if negate else hit).orderBy("path").limit(n)


def extensions_seen(files: DataFrame, n: int = 10) -> DataFrame:
    """Extensions that exist, for when a glob finds nothing."""
    return files.select(T.extension(F.col("path")).alias("ext")).where("ext <> ''").distinct().orderBy("ext").limit(n)


def graded(answers: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """Adds correct: every required substring and no forbidden one, case-insensitive, back ticks left out."""
    body = F.lower(F.replace(F.col("text"), F.lit("`"), F.lit("")))
    have = [F.contains(body, F.lit(r.lower())) for r in required]
    lack = [~F.contains(body, F.lit(f.lower())) for f in forbidden]
    return answers.withColumn("correct", reduce(lambda a, b: a & b, have + lack, F.lit(True)))
