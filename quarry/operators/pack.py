"""Fitting results into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_fit(items: Column, budget: Column | int) -> Column:
    """Indices of the items (array of struct value, tokens) that are taken: by value descending, index ascending, each if it still fits."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    indexed = F.transform(items, lambda x, i: F.struct((-x["value"]).alias("v"), i.alias("i"), x["tokens"].cast("long").alias("t")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, x: F.when(a["used"] + x["t"] <= budget, F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["taken"], F.array(x["i"])).alias("taken"))).otherwise(a)
    return F.array_sort(F.aggregate(F.array_sort(indexed), start, step)["taken"])


def packed(blocks: DataFrame, key: list[str], budget: int, structural: int = 0) -> DataFrame:
    """Blocks (key..., idx, value, tokens) that fit what structure leaves of the budget; a key's blocks are one result's."""
    items = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "value", "tokens"))).alias("b"))
    taken = first_fit(F.transform("b", lambda x: F.struct(x["value"], x["tokens"])), max(0, budget - structural))
    kept = items.withColumn("i", F.explode(taken)).withColumn("x", F.get("b", F.col("i")))
    return kept.select(*key, "x.idx", "x.value", "x.tokens")


def cut(text: Column, tokens: int, reserve: int = 50) -> Column:
    """Text cut to a budget: whole if it fits; else up to the last section, paragraph or line end within it, and a note."""
    room = max(0, tokens - reserve) * 4
    fits = F.octet_length(text) <= tokens * 4
    # at most room bytes, at a character's edge
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, room), "UTF-8")
    head = F.regexp_replace(head, "�+$", "")
    at = lambda mark: F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1
    place = lambda mark: F.when(F.locate(mark[::-1], F.reverse(head)) > 0, at(mark))
    edge = F.coalesce(place("\n\n## "), place("\n\n"), place("\n"), F.length(head))
    return F.when(fits, text).otherwise(F.concat(F.substr(head, F.lit(1), edge.cast("int")), F.lit("\n\n... truncated")))


def degraded(levels: list[Column], budget: int) -> Column:
    """The first level whose text fits the budget, else the last."""
    out = None
    for level in levels:
        fits = F.octet_length(level) <= budget * 4
        out = F.when(fits, level) if out is None else out.when(fits, level)
    return out.otherwise(levels[-1])


def sections(blocks: Column, budget: int) -> Column:
    """Folds ordered blocks (array of struct text, tokens) into a budget; a block that does not fit is replaced by a note."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))
    note = lambda x: F.concat(F.lit("[skipped: "), x["tokens"].cast("string"), F.lit(" tokens]"))
    step = lambda a, x: F.when(a["used"] + x["tokens"] <= budget, F.struct((a["used"] + x["tokens"]).alias("used"), F.concat(a["out"], F.array(x["text"])).alias("out"))).otherwise(F.struct(a["used"].alias("used"), F.concat(a["out"], F.array(note(x))).alias("out")))
    return F.aggregate(blocks, start, step)["out"]


def expanded(matches: DataFrame, order: list[Column], n: int, per_file: bool) -> DataFrame:
    """The matches that are shown in full: the first n in order, only the first of each file if per_file."""
    from pyspark.sql import Window

    if per_file:
        nth = F.row_number().over(Window.partitionBy("path").orderBy(*order))
        matches = matches.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return matches.orderBy(*order).limit(n)
