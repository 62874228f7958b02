"""Statistics over measured runs: groups, medians, upper medians, dense pivots, deltas, costs, sparklines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, mean, sample deviation, least and most of each group; 0 for nothing, deviation 0 for one."""
    v = F.col(value).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), zero(F.median(v)).alias("median"), zero(F.avg(v)).alias("mean"), zero(F.stddev_samp(v)).alias("stdev"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max")
    )


def valid_runs(runs: DataFrame) -> DataFrame:
    return runs.where("error IS NULL")


def median_of_medians(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Median over the inner groups' medians."""
    first = rows.groupBy(*outer, *inner).agg(F.median(F.col(value).cast("double")).alias("m"))
    return first.groupBy(*outer).agg(F.median("m").alias("median"), F.count("*").alias("groups"))


def upper_median(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row at place n // 2 of each group in order."""
    by = Window.partitionBy(*keys)
    nth = F.row_number().over(by.orderBy(*order))
    rows = rows.withColumn("_nth", nth).withColumn("_n", F.count("*").over(by))
    return rows.where(F.expr("_nth = _n div 2 + 1")).drop("_nth", "_n")


def dense_median(runs: DataFrame, run_id: str, counts: str) -> DataFrame:
    """Median count of each map key over all runs, 0 where a run lacks it: name, median.

    A key's counts are taken as frequencies, and the runs without it as a frequency of 0, so
    that no table of runs by keys is made and no key's counts are gathered.
    """
    each = runs.select(run_id, F.explode(counts).alias("name", "n")).groupBy("name", "n").agg(F.count("*").alias("c"))
    total = runs.agg(F.count("*").alias("total")).first()["total"]
    lacking = each.groupBy("name").agg((F.lit(total) - F.sum("c")).alias("c")).where("c > 0").select("name", F.lit(0).alias("n"), "c")
    table = each.union(lacking).groupBy("name", "n").agg(F.sum("c").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("name").orderBy("n"))
    at = lambda place: F.min(F.when(F.col("up_to") > place, F.col("n")))
    return table.withColumn("up_to", up_to).groupBy("name").agg(((at((total - 1) // 2) + at(total // 2)) / 2.0).cast("double").alias("median"))


def cost_per_correct(runs: DataFrame, keys: list[str], correct: str, cost: str) -> DataFrame:
    """runs, correct ones, accuracy, spend, and spend for each correct one (null if there is none)."""
    right = F.sum(F.col(correct).cast("long"))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), right.alias("correct"), (right / F.count("*")).alias("accuracy"), F.sum(cost).alias("spend"), F.try_divide(F.sum(cost), right).alias("cost_per_correct"))


def token_cost(runs: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Adds the cost of each kind of token (rate for a million) and their sum."""
    parts = {f"{k}_cost": F.col(k) * F.lit(r) / 1e6 for k, r in rates.items()}
    total = sum(parts.values(), F.lit(0.0))
    return runs.withColumns({**parts, "token_cost": total})


def delta_percent(old: Column, new: Column) -> Column:
    """Change in percent; 0 where the old value is 0."""
    return F.when(old == 0, 0.0).otherwise((new - old) * 100.0 / old)


def compared(rows: DataFrame, keys: list[str], side: str, old: str, new: str, value: Column) -> DataFrame:
    """Old and new value of each group in both sides, and the change in percent."""
    by = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col(side) == s, value)).alias(n) for s, n in ((old, "old"), (new, "new"))])
    return by.where("old IS NOT NULL AND new IS NOT NULL").withColumn("delta_percent", delta_percent(F.col("old"), F.col("new")))


def version_report(runs: DataFrame, keys: list[str], side: str, old: str, new: str, correct: str, cost: str) -> DataFrame:
    """For each group in both versions: runs, share that is right, median cost, its change in percent, and a verdict; right answers count before cost."""
    by = runs.groupBy(*keys).pivot(side, [old, new]).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.median(cost).alias("median"))
    v = lambda s, c: F.col(f"{s}_{c}")
    verdict = (
        F.when(v(new, "accuracy") > v(old, "accuracy"), "better").when(v(new, "accuracy") < v(old, "accuracy"), "worse")
        .when(v(new, "median") < v(old, "median"), "cheaper").when(v(new, "median") > v(old, "median"), "dearer").otherwise("same")
    )
    numbers = [v(s, c) if c == "runs" else F.round(v(s, c), 6).alias(f"{s}_{c}") for c in ("runs", "accuracy", "median") for s in (old, new)]
    change = F.round(delta_percent(v(old, "median"), v(new, "median")), 6)
    return by.where(v(old, "runs").isNotNull() & v(new, "runs").isNotNull()).select(*keys, *numbers, change.alias("delta_percent"), verdict.alias("verdict"))


def zipped(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Pairs old and new rows of a group by place; rows without a partner fall out."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("nth")
    a = old.select(*keys, nth, *[F.col(c).alias(f"old_{c}") for c in keep])
    b = new.select(*keys, nth, *[F.col(c).alias(f"new_{c}") for c in keep])
    return a.join(b, [*keys, "nth"])


def mix(old: DataFrame, new: DataFrame, name: str, n: str) -> DataFrame:
    """Sums by name on both sides, 0 where a side lacks it."""
    a, b = (d.groupBy(name).agg(F.sum(n).alias(s)) for d, s in ((old, "old"), (new, "new")))
    return a.join(b, name, "full").select(name, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))


def sparkline(values: Column, levels: str = " ▁▂▃▄▅▆▇█") -> Column:
    """One character for each value by its place between the least and the most."""
    low, high = F.array_min(values), F.array_max(values)
    level = lambda v: F.when(high == low, 0).otherwise(F.least(F.floor((v - low) / (high - low) * 8), F.lit(8)))
    return F.array_join(F.transform(values, lambda v: F.substr(F.lit(levels), (level(v) + 1).cast("int"), F.lit(1))), "")


def ratios(runs: DataFrame, turns: str, buckets: dict[str, tuple[str, ...]], counts: str) -> DataFrame:
    """Tool calls by keyword bucket, and for each turn."""
    of = lambda words: F.aggregate(F.map_values(F.map_filter(counts, lambda k, v: _has(k, words))), F.lit(0).cast("long"), lambda a, v: a + v)
    out = runs
    for name, words in buckets.items():
        out = out.withColumn(name, of(words)).withColumn(f"{name}_per_turn", F.try_divide(F.col(name), F.col(turns)))
    return out


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def session_summary(events: DataFrame, kind: str, query: str, directory: str, n: int = 5) -> dict[str, DataFrame]:
    """Counts by kind, and the most frequent queries and directories (by name among equals)."""
    top = lambda c: events.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(n)
    return {"counts": events.groupBy(kind).agg(F.count("*").alias("n")), "queries": top(query), "directories": top(directory)}


def savings(events: DataFrame, baseline: str, shown: str, keys: list[str] | None = None) -> DataFrame:
    """baseline, saved (never below 0 for one event) and whole percent saved."""
    saved = F.greatest(F.col(baseline) - F.col(shown), F.lit(0))
    out = events.groupBy(*(keys or [])).agg(F.sum(baseline).alias("baseline"), F.sum(saved).alias("saved"))
    return out.withColumn("percent", F.expr("CASE WHEN baseline = 0 THEN 0 ELSE CAST(floor(saved * 100 / baseline) AS BIGINT) END"))
