"""Mixing sources to target weights with a time-varying curriculum.

1. Targets: sources weigh 5, 2, 1 in turn by code point (null last) and share a budget.
   A source stops at ``most`` times its size and the excess is reshared by weight until
   none is above: the water level is found with one aggregate for each round.
2. A source's weight schedule over time [0, 1] is piecewise linear.  Its integral, scaled
   to the source's target, is the cumulative token demand.
3. A source's documents stand in a keyed hash order, pass after pass.  The document copy
   that begins at cumulative token c enters training at the time at which demand reaches
   c: the integral inverted, a square root in each segment.
4. Training order is a range sort by position.

Prefix sums over a source are taken in two levels (hash buckets, then documents within a
bucket), so that a source with a third of all rows is spread over many tasks.  Texts are
read once, for their word counts, and never shuffled.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own, last in order; repeated rows count as documents of their own; an empty table gives no
rows; other columns are ignored.  The last copy taken of a source may be cut, which makes
a source's taken words equal its target rounded down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0


@dataclass(frozen=True)
class Schedule:
    """Relative weight of a source at some times, linear between them; times run from 0 to 1."""

    times: tuple[float, ...]
    weights: tuple[float, ...]

    def integral(self) -> list[float]:
        """The share of the whole demand that is met by each time."""
        out = [0.0]
        for k in range(1, len(self.times)):
            out.append(out[-1] + (self.weights[k] + self.weights[k - 1]) / 2 * (self.times[k] - self.times[k - 1]))
        return [x / out[-1] for x in out]

    def scale(self) -> float:
        return sum((self.weights[k] + self.weights[k - 1]) / 2 * (self.times[k] - self.times[k - 1]) for k in range(1, len(self.times)))

    def time_of(self, share: Column) -> Column:
        """The time at which a share of the demand is met: the inverse of the integral."""
        met, whole = self.integral(), self.scale()
        out = F.lit(1.0)
        for k in range(len(self.times) - 1, 0, -1):
            t, w = self.times[k - 1], self.weights[k - 1]
            slope = (self.weights[k] - w) / (self.times[k] - t)
            need = (share - F.lit(met[k - 1])) * F.lit(whole)
            if abs(slope) < 1e-12:
                step = need / F.lit(w)
            else:  # slope/2 x^2 + w x = need, in the form that is stable for small slopes
                step = need * 2 / (F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + need * (2 * slope))))
            out = F.when(share < F.lit(met[k]), F.lit(t) + step).otherwise(out)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))

    def sql(self, share: str) -> str:
        """time_of() for DuckDB."""
        met, whole, num = self.integral(), self.scale(), lambda x: f"{x!r}::DOUBLE"
        out = "1.0::DOUBLE"
        for k in range(len(self.times) - 1, 0, -1):
            t, w = self.times[k - 1], self.weights[k - 1]
            slope = (self.weights[k] - w) / (self.times[k] - t)
            need = f"(({share} - {num(met[k - 1])}) * {num(whole)})"
            step = f"{need} / {num(w)}" if abs(slope) < 1e-12 else f"{need} * 2 / ({num(w)} + sqrt(greatest(0.0::DOUBLE, {num(w * w)} + {need} * {num(2 * slope)})))"
            out = f"CASE WHEN {share} < {num(met[k])} THEN {num(t)} + {step} ELSE {out} END"
        return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {out}))"


#: By place in the weight cycle: heavy sources fade, light ones rise towards the end.
SCHEDULES = (Schedule((0.0, 1.0), (1.4, 0.6)), Schedule((0.0, 0.5, 1.0), (0.8, 1.2, 0.8)), Schedule((0.0, 1.0), (0.4, 1.6)))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of each text), and content: a hash that tells rows with one doc_id apart."""
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(common.WORD)))
    content = F.xxhash64(*(c for c in ("text", "lang", "n_chars") if c in docs.columns))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"), content.alias("content"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank (0 for the first source by code point, null last) by range-sorted partitions and their offsets."""
    order = [F.col("source").asc_nulls_last()]
    placed = sources.repartitionByRange(common.partitions(sources.sparkSession), *order)
    placed = common.materialize(placed.withColumn("part", F.spark_partition_id()), "mixing-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.join(offsets, "part").select("source", "source_size", (F.col("base") + nth).alias("rank"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, budget: float | None = None) -> DataFrame:
    """source, source_size, rank, target.  budget: all words if None; never above most times all words."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = ranked(by_source)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    known = common.materialize(known.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)), "mixing-targets")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    budget = min(float(total) if budget is None else float(budget), most * total)
    level = None
    while True:  # each round caps at least one more source
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        row = known.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("met"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if level is not None and (not row["open"] or row["n"] == seen):
            break
        if not row["open"]:
            level = 0.0
            break
        seen, level = row["n"], (budget - row["met"]) / row["open"]
    return known.select("source", "source_size", "rank", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def curriculum(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, budget: float | None = None, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions (the time in
    training of each of its copies), and content."""
    spark = docs.sparkSession
    sized = sizes(docs)
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    buckets = 16 * common.partitions(spark)
    bucket = F.least(F.floor(order / F.lit((1 << 60) // buckets)), F.lit(buckets - 1))  # in hash order, like the documents in them
    sized = common.materialize(sized.withColumn("h", order).withColumn("bucket", bucket), "mixing-sizes")
    goal = targets(sized, weights, most, budget)
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = bases.withColumn("base", F.coalesce(F.sum("words").over(below), F.lit(0))).drop("words")
    match = bases["source"].eqNullSafe(goal["source"])
    bases = bases.join(goal, match).select(bases["source"].alias("s"), F.col("bucket").alias("b"), "base", "source_size", "rank", "target")
    bases = common.materialize(bases, "mixing-bases")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    found = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    found = found.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    goal_words = F.floor("target")
    offset = F.col("base") + F.col("before")
    passes = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least("size", goal_words - passes * F.col("source_size") - offset))
    copies = passes + (rest > 0).cast("int")
    found = found.withColumn("offset", offset).withColumn("taken", passes * F.col("size") + rest)
    found = found.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    starts = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: (k * F.col("source_size") + F.col("offset")) / F.col("target")))
    starts = F.coalesce(starts, F.array().cast("array<double>"))
    kinds = [F.when(F.pmod("rank", F.lit(len(schedules))) == k, F.transform(starts, s.time_of)) for k, s in enumerate(schedules)]
    return found.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.coalesce(*kinds).alias("positions"), "content")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents, range-sorted by first position in training (not taken: last)."""
    found = curriculum(common.table(spark, sf_dir, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 9).alias("first_position")
    out = found.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", F.size("positions").cast("long").alias("copies"), first)
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(concat('7:', doc_id)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS met, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS rest FROM w
  WINDOW p AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - met) / rest, cap / weight) FILTER (weight * ((total - met) / rest) <= cap), 0) AS level FROM o),
t AS (SELECT source, source_size, rank, least(cap, weight * level) AS target FROM w, l),
q AS (SELECT d.doc_id, d.source, size, source_size, target, rank, floor(target)::BIGINT AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM q),
x AS (SELECT *, greatest(0, least(size, goal - passes * source_size - off)) AS more FROM r),
y AS (SELECT *, CASE WHEN size > 0 THEN passes + (more > 0)::INT ELSE 0 END::BIGINT AS copies, off / target AS share FROM x)
SELECT doc_id, source, size, source_size, target, (passes * size + more)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE rank % 3 WHEN 0 THEN {SCHEDULES[0].sql("share")} WHEN 1 THEN {SCHEDULES[1].sql("share")} ELSE {SCHEDULES[2].sql("share")} END, 9) END AS first_position
FROM y
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, range-sorted by position.

    Rows are told apart by doc_id, source and the hash of their other columns, so rows that share a
    doc_id (or have none) are documents of their own, and equal rows are taken each for itself.
    The copy that a source's target ends in keeps its first words only (joined by one
    space, n_chars recounted); the rest of that copy isn't taken.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = curriculum(docs).where("taken > 0")
    copies = found.select("doc_id", "source", "content", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    left = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    key = F.xxhash64("doc_id", "source", "content")
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("content").alias("_content"), "position", F.when(left < F.col("size"), left).cast("int").alias("_words"), key.alias("_other"))
    kept = docs.withColumn("content", F.xxhash64("text", "lang", "n_chars")).withColumn("_key", key).repartition(common.partitions(spark), "_key")
    nth = Window.partitionBy("_key", "doc_id", "source", "content").orderBy("n_chars")  # of rows that are equal, one
    kept = kept.withColumn("_nth", F.row_number().over(nth)).where("_nth = 1")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("content") == F.col("_content"))
    rows = kept.join(copies, (F.col("_key") == F.col("_other")) & match)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)), F.lit(1), F.col("_words")), " ")
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(cut)
    out = rows.withColumn("text", text).withColumn("n_chars", F.when(F.col("_words").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.orderBy("position", "doc_id", "content").select("doc_id", "text", "lang", "source", "n_chars")
