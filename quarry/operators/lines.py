"""Lines of texts and logic over neighbouring lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..sources.cuts import cut


def lines(files: DataFrame, key: list[str] | None = None, text: str = "text") -> DataFrame:
    """key..., line (from 1), text: one row per line; no line after a final line end, no carriage return."""
    key = key or ["path"]
    body = F.when(F.endswith(text, F.lit("\n")), F.expr(f"substring({text}, 1, length({text}) - 1)")).otherwise(F.col(text))
    split = F.when(F.length(text) > 0, F.split(body, "\n", -1))
    out = files.select(*key, F.posexplode(split).alias("line", "text"))
    return out.select(*key, (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def head_tail(rows: DataFrame, key: list[str], order: str, head: int, tail: int) -> DataFrame:
    """The first and last rows of each group; part is head or tail, total the group's size."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    total = F.count("*").over(Window.partitionBy(*key))
    rows = rows.withColumn("nth", nth).withColumn("total", total)
    part = F.when(F.col("nth") <= head, "head").when(F.col("nth") > F.col("total") - tail, "tail")
    return rows.withColumn("part", part).where("part is not null")


def body_slice(rows: DataFrame, key: list[str], order: str, budget: int) -> DataFrame:
    """Two thirds of a budget of rows from the front, one third from the back."""
    return head_tail(rows, key, order, budget * 2 // 3, budget - budget * 2 // 3)


def collapse_blanks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Drops every blank line that follows a blank line."""
    before = F.lag(F.trim("text") == "").over(Window.partitionBy(*key).orderBy("line"))
    return rows.withColumn("_before", before).where((F.trim("text") != "") | ~F.coalesce("_before", F.lit(False))).drop("_before")


def strip_noise(rows: DataFrame, key: list[str], lang: Column) -> DataFrame:
    """collapse_blanks, and no debug logs or plain comments; a stripped line still ends a run of blanks."""
    return collapse_blanks(rows, key).where(~rules.is_noise(F.col("text"), lang))


def gaps(kept: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Adds skipped: how many lines are missing before a line, where more than least are; else 0."""
    before = F.coalesce(F.lag("line").over(Window.partitionBy(*key).orderBy("line")), F.lit(0))
    n = F.col("line") - before - 1
    return kept.withColumn("skipped", F.when(n > least, n).otherwise(0))


def runs(rows: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """Runs of consecutive lines: key..., first, last, n."""
    island = F.col(line) - F.row_number().over(Window.partitionBy(*key).orderBy(line))
    found = rows.withColumn("_island", island).groupBy(*key, "_island")
    return found.agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("n")).drop("_island")


def run_list(rows: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """key..., lines: "50,55-58,63"; a run of two is "a,b"."""
    first, last = F.col("first").cast("string"), F.col("last").cast("string")
    part = F.when(F.col("n") == 1, first).when(F.col("n") == 2, F.concat_ws(",", first, last)).otherwise(F.concat_ws("-", first, last))
    found = runs(rows.select(*key, line).distinct(), key, line).withColumn("part", part)
    ordered = F.array_sort(F.collect_list(F.struct("first", "part")))
    return found.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda r: r["part"]), ",").alias("lines"))


def consecutive_groups(ranked: DataFrame, order: list[Column], same: list[str]) -> DataFrame:
    """Adds island: a number for each run of rows that are adjacent in the order and agree on same.  For one query's matches."""
    over = Window.partitionBy("q").orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.lag(c).over(over).eqNullSafe(F.col(c))
    return ranked.withColumn("_new", change.cast("int")).withColumn("island", F.sum("_new").over(over)).drop("_new")


def diverse_lines(rows: DataFrame, key: list[str], query: str | None = None, most: int = 40, least: int = 80, match: int = 50, near: int = 5) -> DataFrame:
    """The most important lines of blocks of more than least lines, in order: key..., line, text, score.

    A line that holds the query gains match, and each neighbour of one gains near.
    """
    by = Window.partitionBy(*key)
    over = by.orderBy("line")
    rows = rows.withColumn("_first", F.min("line").over(by)).withColumn("_last", F.max("line").over(by))
    rows = rows.where(F.col("_last") - F.col("_first") >= least)
    points = rules.importance(F.col("text"), F.col("line") == F.col("_first"), F.col("line") == F.col("_last"))
    if query:
        hit = F.contains("text", F.lit(query)).cast("int")
        rows = rows.withColumn("_hit", hit)
        beside = F.coalesce(F.lag("_hit").over(over), F.lit(0)) + F.coalesce(F.lead("_hit").over(over), F.lit(0))
        points = points + F.col("_hit") * match + beside * near
    rows = rows.withColumn("score", points)
    nth = F.row_number().over(by.orderBy(F.desc("score"), "line"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).select(*key, "line", "text", "score")


def within_budget(rows: DataFrame, key: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows while the running cost stays within the budget; adds running.  Order is total within a key.

    Sums are taken in two levels, within ranges of the order and over ranges, so that a key with most rows is spread.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(*key, "_part").agg(F.sum(cost).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    base = base.where(F.col("_base") <= budget).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_part").alias("_p"), "_base")
    on = F.col("_part") == F.col("_p")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    over = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(base, on).withColumn("running", F.col("_base") + F.sum(cost).over(over)).where(F.col("running") <= budget)
    return out.select(*rows.columns, "running")


def headings(rows: DataFrame, key: list[str]) -> DataFrame:
    """ATX headings outside of fences: key..., line, level, heading, end_line (of its section, trailing blanks left out)."""
    by = Window.partitionBy(*key)
    over = by.orderBy("line")
    fence = F.col("text").rlike(r"^ {0,3}(?:```|~~~)").cast("int")
    rows = rows.withColumn("_fence", fence).withColumn("_open", F.sum("_fence").over(over) % 2 + F.col("_fence"))
    rows = rows.withColumn("level", F.when(F.col("_open") == 0, T.heading_level(F.col("text"))).otherwise(0))
    filled = F.max(F.when(F.trim("text") != "", F.col("line"))).over(over)
    rows = rows.withColumn("_filled", filled).withColumn("_total", F.max("_filled").over(by))
    found = rows.where("level > 0").select(*key, "line", "level", T.heading_text(F.col("text")).alias("heading"), "_total")
    # the nearest later heading of a level up to its own: running minima from the file's end
    later = by.orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    stops = F.array(*(F.min(F.when(F.col("level") <= n, F.col("line"))).over(later) for n in range(1, 7)))
    ends = found.withColumn("_stop", F.element_at(stops, F.col("level")))
    edges = rows.select(*[F.col(k).alias(f"_{k}") for k in key], (F.col("line") + 1).alias("_at"), F.col("_filled").alias("_end"))
    on = F.col("_stop") == F.col("_at")
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return ends.join(edges, on, "left").select(*key, "line", "level", "heading", F.coalesce("_end", "_total").alias("end_line"))


def around(rows: DataFrame, key: list[str], hit: Column, n: int = 2) -> DataFrame:
    """Rows within n rows of a hit: the columns of rows, and hit."""
    rows = rows.withColumn("hit", hit)
    near = F.max(F.col("hit").cast("int")).over(Window.partitionBy(*key).orderBy("line").rowsBetween(-n, n))
    return rows.withColumn("_near", near).where("_near = 1").drop("_near")


def view(rows: DataFrame, key: list[str], kind: Column) -> DataFrame:
    """Log files: 10 first and 5 last lines; others: 50 and 10; tables: header, 5 first and 3 last rows."""
    rows = rows.withColumn("_kind", kind)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    rows = rows.withColumn("nth", nth).withColumn("total", F.count("*").over(Window.partitionBy(*key)))
    head = F.when(F.col("_kind") == "log", 10).when(F.col("_kind") == "tabular", 6).otherwise(50)
    tail = F.when(F.col("_kind") == "log", 5).when(F.col("_kind") == "tabular", 3).otherwise(10)
    part = F.when(F.col("nth") <= head, "head").when(F.col("nth") > F.col("total") - tail, "tail")
    return rows.withColumn("part", part).where("part is not null").drop("_kind", "nth")


def code_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Fenced blocks of each Markdown file."""
    fences = F.count_if(F.col("text").rlike(r"^ {0,3}(?:```|~~~)"))
    return rows.groupBy(*key).agg(F.floor((fences + 1) / 2).alias("blocks"))


def expanded(rows: DataFrame, matches: DataFrame, around: int = 10, whole: int = 800) -> DataFrame:
    """Lines to show for matches (path, line, def_start, def_end): all of a file of few tokens, else the definition or some lines around; leading imports of a file's top are left out."""
    sizes = rows.groupBy("path").agg(F.sum(F.octet_length("text") + 1).alias("_bytes"))
    m = matches.select("path", F.col("line").alias("match"), F.coalesce("def_start", F.col("line") - around).alias("_a"), F.coalesce("def_end", F.col("line") + around).alias("_b"))
    out = rows.join(m.join(sizes, "path"), "path").where((F.col("_bytes") < whole * 4) | ((F.col("line") >= F.col("_a")) & (F.col("line") <= F.col("_b"))))
    lead = (F.col("_a") <= 5) & (F.col("line") < F.col("match")) & F.col("text").rlike(r"^\s*(?:import |from |use |#include|require )")
    return out.where(~lead).select("path", "match", "line", "text").orderBy("path", "match", "line")
