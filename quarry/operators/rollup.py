"""Sums over directory prefixes, histograms, modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ancestors(path):
    """All directories that hold a path, the root as an empty string."""
    parts = F.split(T.dirname(path), "/")
    n = F.when(T.dirname(path) == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def directory_totals(files: DataFrame, value: str) -> DataFrame:
    """dir, total, files: each directory with all that is below it."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir"), value).groupBy("dir").agg(F.sum(value).alias("total"), F.count("*").alias("files"))


def histogram(files: DataFrame, column: str) -> DataFrame:
    return files.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def primary(files: DataFrame, group: str, column: str) -> DataFrame:
    """The most frequent value of each group, the first by name of equals."""
    counts = files.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), column))
    return counts.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def modules(files: DataFrame, least: int = 2, n: int | None = 10) -> DataFrame:
    """Directories with at least so many files of the tree's primary language; the first n by files, then name."""
    counts = files.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("c"))
    main = counts.orderBy(F.desc("c"), "lang").limit(1).select(F.col("lang").alias("_main"))
    own = files.join(main, files["lang"] == main["_main"]).withColumn("dir", T.dirname(F.col("path")))
    found = own.where("dir <> ''").groupBy("dir").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    return found if n is None else found.orderBy(F.desc("files"), "dir").limit(n)


# Directories that hold no modules.
NON_SOURCE = (
    "test", "tests", "__tests__", "spec", "specs", "doc", "docs", "docs_src", "documentation", "example", "examples", "sample", "samples", "script",
    "scripts", "tools", "fixtures", "benchmark", "benchmarks", "bench", ".github", ".vscode", ".idea", "vendor", "node_modules", "target", "dist", "build",
)


def module_names(files: DataFrame, least: int = 2, n: int = 10) -> DataFrame:
    """modules for display: name, files.

    A first directory that all of them share is left out of their names, and so is the module that is that directory
    itself; modules within directories that hold no source are left out.  The first n by files, then name.
    """
    found = modules(files, least, None)
    top = F.substring_index("dir", "/", 1)
    shared = found.agg(F.min(top).alias("_a"), F.max(top).alias("_b"), F.max(F.contains("dir", F.lit("/"))).alias("_deep"), F.count("*").alias("_n"))
    shared = shared.select(F.when((F.col("_a") == F.col("_b")) & F.col("_deep") & (F.col("_n") > 1), F.col("_a")).alias("_top"))
    rest = F.when(F.col("_top").isNull(), F.col("dir")).when(F.col("dir") != F.col("_top"), F.expr("substring(dir, length(_top) + 2)"))
    named = found.join(shared, how="cross").select(rest.alias("name"), "files").where("name IS NOT NULL")  # shared is one row
    no_source = F.exists(F.split(F.lower("name"), "/"), lambda part: part.isin(*NON_SOURCE))
    return named.where(~no_source).orderBy(F.desc("files"), "name").limit(n)


def package_roots(files: DataFrame, manifests: list[str]) -> DataFrame:
    """path, root: the nearest ancestor that holds a manifest, or null."""
    roots = files.where(T.basename(F.col("path")).isin(*manifests)).select(T.dirname(F.col("path")).alias("root")).distinct()
    each = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    found = each.join(roots, each["dir"] == roots["root"]).groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("path").join(found, "path", "left")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def import_summary(imports: DataFrame, n: int = 5) -> DataFrame:
    """Imports of each file by source with counts, the first n in order of first appearance, and how many there are."""
    by = imports.groupBy("path", "source").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    w = Window.partitionBy("path")
    by = by.withColumn("nth", F.row_number().over(w.orderBy("line", "source"))).withColumn("total", F.count("*").over(w))
    return by.where(F.col("nth") <= n)
