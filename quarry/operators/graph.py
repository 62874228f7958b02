"""Call and import edges: batched lookups, bounded hops, reachability, prioritised resolution, interval containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import cut


def callers(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Call sites whose callee is a target: one scan for all targets."""
    return calls.join(targets.select(F.col("name").alias("callee")).distinct(), "callee")


def impact(calls: DataFrame, targets: DataFrame, fan_out: int = 10, shown: int | None = None) -> DataFrame:
    """Callers of the targets (hop 1), and callers of those (hop 2) if there are 1 to fan_out of them.

    A site of hop 1 is no site of hop 2; hop 2 has one site for each caller and path.
    """
    first = callers(calls, targets).withColumn("hop", F.lit(1))
    names = first.select(F.col("caller").alias("name")).where("name is not null").distinct()
    few = names.agg(F.count("*").alias("n")).where(f"n between 1 and {fan_out}")
    second = callers(calls, names.join(few, how="cross").select("name"))  # few is one row at most
    second = second.join(first.select("path", "line").distinct(), ["path", "line"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("caller", "path").orderBy("line", "callee"))
    second = second.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("hop", F.lit(2))
    if shown is not None:
        second = second.orderBy("path", "line").limit(shown)
    return first.unionByName(second)


def impact_totals(sites: DataFrame) -> DataFrame:
    """One row for impact's sites: callers (distinct names at hop 1), sites (at hop 1), indirect (distinct callers and files at hop 2)."""
    at = lambda hop, *columns: F.count_distinct(F.when(F.col("hop") == hop, F.struct(*columns)))
    return sites.agg(at(1, "caller").alias("callers"), F.count_if(F.col("hop") == 1).alias("sites"), at(2, "caller", "path").alias("indirect"))


def footer(called: DataFrame, path: str, order: list[Column], n: int = 8) -> DataFrame:
    """What is shown of the definitions that a match calls: all up to n of them, else those of other files first, each in order."""
    rows = called.withColumn("_total", F.count("*").over(Window.partitionBy(F.lit(0))))  # those of one definition
    own = F.when(F.col("_total") > n, F.col("path") == path).otherwise(F.lit(False))
    return rows.orderBy(own, *order).limit(n).drop("_total")


def ranked_callers(sites: DataFrame, context: str | None = None) -> DataFrame:
    """Context file first, then by depth, path and line."""
    return sites.orderBy(F.when(F.col("path") == (context or ""), 0).otherwise(1), F.size(F.split("path", "/")), "path", "line")


def two_hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node, hop): what each root reaches by edges (src, dst) in one or two steps, at its first hop."""
    e = edges.select("src", "dst").distinct()
    one = start.select(F.col("node").alias("root")).join(e, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(1).alias("hop"))
    two = one.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(2).alias("hop"))
    return one.union(two).where("node <> root").groupBy("root", "node").agg(F.min("hop").alias("hop"))


def resolve(names: DataFrame, candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key: names joined to candidates (key..., and what order uses)."""
    found = names.join(candidates, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return found.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """For each point the deepest span with start <= at <= end of the same key (latest start, then earliest end); null where there is none.

    The key makes it an equi join with a residual; the hot key of one file is bounded by the file.
    """
    inside = (points[key] == spans[key]) & (spans["start"] <= points[at]) & (points[at] <= spans["end"])
    best = F.max_by(F.struct(*[spans[c] for c in keep]), F.struct(spans["start"], -spans["end"], *[spans[c] for c in keep])).alias("_best")
    out = points.join(spans, inside, "left").groupBy(*[points[c] for c in points.columns]).agg(best)
    return out.select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in keep])


def first_enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """As innermost, but the first span in order of start (outermost)."""
    inside = (points[key] == spans[key]) & (spans["start"] <= points[at]) & (points[at] <= spans["end"])
    best = F.min_by(F.struct(*[spans[c] for c in keep]), F.struct(spans["start"], -spans["end"], *[spans[c] for c in keep])).alias("_best")
    out = points.join(spans, inside, "left").groupBy(*[points[c] for c in points.columns]).agg(best)
    return out.select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in keep])


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, band: int = 3) -> DataFrame:
    """Spans whose signature band [start, min(start + band, end)] an edited range (start, end) touches."""
    r = ranges.select(F.col(key).alias("_key"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    on = (F.col(key) == F.col("_key")) & (F.col("start") <= F.col("_b")) & (F.col("_a") <= F.least(F.col("start") + band, F.col("end")))
    return spans.join(r, on, "left_semi")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hop): everything that the start nodes reach, at its first hop.

    Breadth first: each level is joined to the edges, what was seen before is left out, and the level is
    written, until a level is empty; so cycles end and no path is cut.
    """
    edges = cut(edges.select("src", "dst").distinct())
    levels, hop = [cut(start.select("node", F.lit(0).alias("hop")).distinct())], 0
    while not levels[-1].isEmpty():
        hop += 1
        seen = reduce(DataFrame.union, levels)
        found = levels[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        levels.append(cut(found.withColumn("hop", F.lit(hop))))
        if len(levels) > 16:  # plans stay short
            levels = [cut(reduce(DataFrame.union, levels[:-1])), levels[-1]]
    return reduce(DataFrame.union, levels)


def used_by(calls: DataFrame, exported: DataFrame, path: str, most: int = 25) -> DataFrame:
    """Reverse dependencies of a file: who calls its exported names (longest first if there are more than most), by file and caller."""
    names = exported.orderBy(F.desc(F.octet_length("name")), "name").limit(most)
    found = callers(calls, names).where(F.col("path") != path)
    return found.groupBy("path", "caller").agg(F.min("line").alias("line"), F.array_sort(F.collect_set("callee")).alias("symbols"))


def blast(calls: DataFrame, touched: DataFrame, is_test: Column) -> DataFrame:
    """Callers of each touched symbol: production and test sites, and the files they are in."""
    found = callers(calls, touched).withColumn("_test", is_test)
    return found.groupBy("callee").agg(F.count_if(~F.col("_test")).alias("production"), F.count_if("_test").alias("tests"), F.count_distinct("path").alias("files"))


def hot_targets(imports: DataFrame, n: int = 5, least: int = 2) -> DataFrame:
    """Most imported files: target, importers, and the symbol imported most (first by name of equals)."""
    counts = imports.groupBy("target").agg(F.count_distinct("path").alias("importers")).where(F.col("importers") >= least)
    by = imports.groupBy("target", "symbol").agg(F.count("*").alias("uses"))
    nth = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("uses"), "symbol"))
    best = by.withColumn("_nth", nth).where("_nth = 1").select("target", "symbol")
    return counts.join(best, "target", "left").orderBy(F.desc("importers"), "target").limit(n)


def peers(symbols: DataFrame, path: str, name: str, n: int = 8) -> DataFrame:
    """Symbols with the same parent as the named one, functions first; neither itself nor imports and exports."""
    own = symbols.where((F.col("path") == path) & (F.col("name") == name)).select(F.col("path").alias("_path"), F.col("parent_id").alias("_parent"), F.col("sym_id").alias("_id"))
    found = symbols.join(own, (F.col("path") == F.col("_path")) & F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("sym_id") != F.col("_id")))
    found = found.where(~F.col("kind").isin("import", "export")).drop("_path", "_parent", "_id")
    return found.orderBy(F.when(F.col("kind") == "function", 0).otherwise(1), "name").limit(n)
