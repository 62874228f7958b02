"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A document's paragraphs (lines, cut into pieces of at most ``PIECE`` words) are hashed to a
set of digests.  A sketch has four subtables of cells; a digest is added to one cell of
each: to its count, to the XOR of its digests and to the XOR of their checks.  The sketch of
another version subtracts.  A cell with count 1 or -1 whose check fits holds one digest
that is in one version only; taking it out of its other cells may uncover more.  When
all cells are empty, every differing digest has been recovered, and the likeness of the
versions is the share of digests they have in common (Jaccard).

The fingerprint of a text is its sketch, sized for all of its digests (``width``), so it can be
peeled by itself and subtracted from any other of its size.  Versions are compared at the
larger one's width, and a text with the next, which has little in common with it, at the
width of both together; where peeling fails, it is tried again with twice the cells, until
none fails.  As text, a fingerprint is ``width/position:count:digests:checks.position:...`` in
hexadecimal, of the cells that aren't empty.

Texts are shuffled once, by range buckets of doc_id, where each meets the next; from there on
only digests are read and shuffled, by row.  The digests of rows to try again are found with a
bit map of fixed size, so no step's plan depends on the input's size.

Defined results: null text is empty; an empty text has an empty sketch; two empty sketches
are alike (1); a null doc_id comes first in order; rows with one doc_id follow each other in
the order of their texts' hashes (a doc_id with many rows is split between buckets by that
hash); the only row of a table is its own next; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIECE, CELLS, LEAST, STEPS, SUBTABLES, MAP_BITS = 6, 2.0, 8, 12, 4, 20
FIRST = -(1 << 63)  # stands for a null doc_id, and for no bound of the hash
UNIT = rf"{common.WORD}(?:[\x20\x09]+{common.WORD}){{0,{PIECE - 1}}}"
#: Cells that hold totals, beside the sketch's own (0 and up).
ONLY_A, ONLY_B, SIZE_A, SIZE_B = -1, -2, -3, -4


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(7)), 32)


def slot(digest: Column, subtable: int, width: Column) -> Column:
    """The cell of a digest in a subtable of a sketch of width cells for each."""
    return (F.pmod(F.xxhash64(digest, F.lit(subtable)), width) + width * subtable).cast("int")


def width(n: Column) -> Column:
    """Cells in each subtable of a sketch for n digests: four steps between powers of two."""
    need = n * F.lit(CELLS / SUBTABLES) + LEAST
    step = F.pow(F.lit(2.0), F.floor(F.log2(need)) - 2)
    return (F.ceil(need / step) * step).cast("int")


def _added(x: Column, w: Column, sign: Column) -> Column:
    """The cells that a digest goes to."""
    return F.array(*(_cell(slot(x, j, w), sign, x, check(x)) for j in range(SUBTABLES)))


def fingerprints(rows: DataFrame, sets: dict[str, str]) -> DataFrame:
    """id, and for each set of digests of rows (id, sets and their widths) its sketch's cells as text; rows are partitioned by id."""
    tagged = F.concat(*(F.transform(c, _tag(i, F.col(w))) for i, (c, w) in enumerate(sets.items())))
    each = rows.select("id", F.explode(tagged).alias("t")).select("id", "t.set", "t.w", F.explode(_added(F.col("t.x"), F.col("t.w"), F.lit(1))).alias("cell"))
    cells = each.select("id", "set", "cell.*").groupBy("id", "set", "pos").agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("proof").alias("proof"))
    text = F.concat_ws(":", *(F.hex(c) for c in ("pos", "cnt", "key", "proof")))
    found = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("set", "pos", text.alias("cell")))).alias("cells"))
    return found.select("id", *(F.array_join(F.transform(F.filter("cells", _in(i)), lambda c: c["cell"]), ".").alias(name) for i, name in enumerate(sets)))


def _tag(i: int, w: Column):
    return lambda x: F.struct(F.lit(i).alias("set"), w.alias("w"), x.alias("x"))


def _in(i: int):
    return lambda c: c["set"] == i


def _cell(pos: Column, cnt: Column, key: Column, proof: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), cnt.cast("long").alias("cnt"), key.cast("long").alias("key"), proof.cast("long").alias("proof"))


def peeled(pairs: DataFrame, by: list[str], scale: int = 1, steps: int = STEPS) -> DataFrame:
    """Recovers the differences of pairs (by..., a, b, width): by..., size_a, size_b, only_a, only_b, left.

    The sketches that subtract have scale times width cells in a subtable; left counts cells that could not
    be peeled.  If pairs are partitioned by some of the columns in by, nothing is shuffled.
    """
    signed = F.concat(
        F.transform("a", lambda x: F.struct(F.lit(1).alias("sign"), x.alias("x"))),
        F.transform("b", lambda x: F.struct(F.lit(-1).alias("sign"), x.alias("x"))),
        F.array(F.struct(F.lit(0).alias("sign"), F.size("a").cast("long").alias("x")), F.struct(F.lit(2).alias("sign"), F.size("b").cast("long").alias("x"))),
    )
    rows = pairs.select(*by, (F.col("width") * scale).alias("width"), F.explode(signed).alias("i")).select(*by, "width", "i.sign", "i.x")
    x, w, sign = F.col("x"), F.col("width"), F.col("sign")
    sizes = F.array(_cell(F.when(sign == 0, SIZE_A).otherwise(SIZE_B), x, F.lit(0), F.lit(0)))
    cells = rows.select(*by, "width", F.explode(F.when(sign.isin(1, -1), _added(x, w, sign)).otherwise(sizes)).alias("cell"))
    cells = _summed(cells, by)
    pos, cnt, key = F.col("pos"), F.col("cnt"), F.col("key")
    for step in range(steps):
        j = step % SUBTABLES
        pure = (pos >= w * j) & (pos < w * (j + 1)) & (F.abs(cnt) == 1) & (F.col("proof") == check(key))
        taken = [_cell(slot(key, k, w), -cnt, key, F.col("proof")) for k in range(SUBTABLES) if k != j]
        taken.append(_cell(F.when(cnt == 1, ONLY_A).otherwise(ONLY_B), F.lit(1), F.lit(0), F.lit(0)))
        same = F.array(_cell(pos, cnt, key, F.col("proof")))
        cells = _summed(cells.select(*by, "width", F.explode(F.when(pure, F.array(*taken)).otherwise(same)).alias("cell")), by)
    of = lambda p: F.coalesce(F.sum(F.when(pos == p, cnt)), F.lit(0))
    return cells.groupBy(*by).agg(of(SIZE_A).alias("size_a"), of(SIZE_B).alias("size_b"), of(ONLY_A).alias("only_a"), of(ONLY_B).alias("only_b"), F.count_if(pos >= 0).alias("left"))


def _summed(cells: DataFrame, by: list[str]) -> DataFrame:
    out = cells.select(*by, "width", "cell.*").groupBy(*by, "width", "pos").agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("proof").alias("proof"))
    return out.where("pos < 0 OR cnt <> 0 OR key <> 0 OR proof <> 0")


def likeness() -> Column:
    """Jaccard likeness from a row of peeled()."""
    union = F.col("size_a") + F.col("only_b")
    return F.when(union == 0, 1.0).otherwise((F.col("size_a") - F.col("only_a")) / union)


def _bounds(docs: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """The first (k, hash) of each range bucket that has rows, one pair for each bucket.

    Buckets are cut by quantiles of k, and by quantiles of the hash for a k that fills buckets of its own.
    Quantiles are approximate, so the rows say what is first between two of them.
    """
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    row = docs.agg(F.min("k").alias("first"), F.percentile_approx("k", cuts, max(10_000, 10 * buckets)).alias("cut")).first()
    if row["first"] is None:
        return []
    ks = [row["first"], *(row["cut"] if buckets > 1 else [])]
    out, many = {(k, FIRST) for k in ks}, sorted(k for k in set(ks) if ks.count(k) > 2)
    if many:
        near = F.array(*(F.lit(k) for k in many))
        inner = docs.withColumn("near", F.array_max(F.filter(near, lambda m: m <= F.col("k")))).groupBy("near").agg(F.percentile_approx("hash", cuts, max(10_000, 10 * buckets)).alias("cut"))
        own = {r["near"]: r["cut"] for r in inner.collect()}
        out |= {(k, h) for k in many for h in own.get(k, ())[:: max(1, buckets // ks.count(k))]}
    hash_ = F.col("hash") if many else F.lit(FIRST)  # texts are read for their hashes only where ids are shared
    first = docs.groupBy(_bucket(sorted(out), hash_)[0].alias("b")).agg(F.min(F.struct("k", hash_.alias("h"))).alias("first"))
    return sorted((r["first"]["k"], r["first"]["h"]) for r in first.collect())


def _bucket(bounds: list[tuple[int, int]], hash_: Column) -> tuple[Column, Column]:
    """A row's bucket and whether it may be the bucket's first, by two lookups in lists of about the square root's length."""
    pair = lambda k, h: F.struct(k.cast("long").alias("k"), h.cast("long").alias("h"))
    own = pair(F.col("k"), hash_)
    listed = lambda x: F.array(*(pair(F.lit(k), F.lit(h)) for k, h in x))
    step = math.isqrt(len(bounds) - 1) + 1
    at = F.size(F.filter(listed(bounds[::step]), lambda b: b <= own))
    near = F.element_at(F.array(*(listed(bounds[i : i + step]) for i in range(0, len(bounds), step))), at)
    place = F.size(F.filter(near, lambda b: b <= own))
    found = F.element_at(near, place)
    return ((at - 1) * step + place - 1).cast("int"), (found["k"] == F.col("k")) & ((found["h"] == FIRST) | (found["h"] == hash_))


def neighbours(docs: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(id, k, text, found: its digests) for every row of docs (k, hash, text), and text and digests of its next in ascending order (next_...).

    The first rows of a bucket are also dealt to the bucket before it, as the next of its last.
    """
    bucket, first = _bucket(bounds, F.col("hash"))
    n = len(bounds)
    places = F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("copy")))
    before = F.array(F.struct(F.pmod(F.col("b") - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("copy")))
    rows = docs.withColumn("b", bucket).withColumn("first", first)
    rows = rows.select("k", "hash", "text", F.explode(F.when(F.col("first"), F.concat(places, before)).otherwise(places)).alias("p")).select("p.bucket", "p.copy", "k", "hash", "text")
    rows = rows.repartition(n, "bucket").withColumn("found", digests(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("copy", "k", "hash")
    nth = F.row_number().over(order)
    rows = rows.select("*", (F.shiftleft(F.col("bucket").cast("long"), 40) + nth).alias("id"), *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "found")))
    return rows.where("copy = 0").select("id", "k", "text", "found", "next_text", "next_found")


def edited(text: Column, next_text: Column) -> Column:
    """text with the last half of its code points replaced by the first as many of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(next_text, F.lit(1), half))


#: The digests of a row's text, its edited text and the next, and the widths to compare them at.
DIGESTS = ["id", "own", "edited", "following", "own_w", "edited_w", "both_w"]


def _pairs(rows: DataFrame) -> DataFrame:
    """Both comparisons of each row (DIGESTS): with its edited text (c = 0) and with the next row (c = 1)."""
    both = F.array(
        F.struct(F.lit(0).alias("c"), F.greatest("own_w", "edited_w").alias("width"), F.col("edited").alias("b")),
        F.struct(F.lit(1).alias("c"), F.col("both_w").alias("width"), F.col("following").alias("b")),
    )
    return rows.withColumn("p", F.explode(both)).select("id", F.col("own").alias("a"), "p.*")


def _of(keys: DataFrame) -> Column:
    """Whether id is, by its hash, in a bit map of keys (id): all that are, and about one in 2**MAP_BITS / keys that aren't."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS))
    bit = F.expr("shiftleft(1, CAST(pmod(xxhash64(id), 8) AS INT))")
    bits = keys.select(F.shiftright(place, 3).alias("at"), bit.alias("bit"))
    table = bytearray(1 << MAP_BITS - 3)
    for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # one row for each of 2**17 bytes at most
        table[r["at"]] = r["bits"]
    held = F.conv(F.hex(F.substr(F.unhex(F.lit(table.hex())), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.bitwiseAND(bit) != 0


def compared(rows: DataFrame) -> DataFrame:
    """(id, near_edited, near_next) of rows (DIGESTS); retries larger until no comparison fails."""
    by, scale, parts = ["id", "c"], 1, 6 * common.partitions(rows.sparkSession)
    found = common.materialize(peeled(_pairs(rows.select(*DIGESTS).repartition(parts, "id")), by), "iblt")
    good = lambda: found.where("left = 0").select(*by, likeness().alias("near"))
    out, few = good(), rows
    while not (lost := common.materialize(found.where("left > 0").select(*by), "iblt-lost")).isEmpty():
        scale *= 2
        few = common.materialize(few.where(_of(lost)).join(lost.select("id").distinct().hint("merge"), "id").select(*DIGESTS), "iblt-few")
        pairs = _pairs(few).join(lost.hint("merge"), by)
        found = common.materialize(peeled(pairs, by, scale, STEPS + 4), "iblt")
        out = out.union(good())
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("near")))
    return out.groupBy("id").agg(pick(0).alias("near_edited"), pick(1).alias("near_next"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    parts = 6 * common.partitions(spark)
    bounds = _bounds(rows, parts)
    if not bounds:
        empty = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], empty)
    found = neighbours(rows, bounds).withColumn("other", edited(F.col("text"), F.col("next_text")))
    found = found.select(
        "id", F.when(F.col("k") != FIRST, F.col("k")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("other", 256).alias("edited_sha256"),
        F.col("found").alias("own"), digests(F.col("other")).alias("edited"), F.col("next_found").alias("following"),
    )
    found = found.withColumns({"own_w": width(F.size("own")), "edited_w": width(F.size("edited")), "both_w": width(F.size("own") + F.size("following"))})
    found = common.materialize(found, "iblt-rows")
    near = compared(found)
    texts = fingerprints(found.select("id", "own", "edited", "own_w", "edited_w").repartition(parts, "id"), {"own": "own_w", "edited": "edited_w"})
    out = found.select("id", "doc_id", "n_chars", "edited_sha256", "own_w", "edited_w").hint("merge").join(texts.hint("merge"), "id", "left").join(near.hint("merge"), "id")
    sketch = lambda w, cells: F.lower(F.concat(F.hex(w), F.lit("/"), F.coalesce(cells, F.lit(""))))
    return out.select("doc_id", "n_chars", "edited_sha256", sketch("own_w", F.col("own")).alias("fingerprint"), sketch("edited_w", F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every document and its edited text, and their likeness."""
    return fingerprinted(common.table(spark, sf_dir, "documents"))
