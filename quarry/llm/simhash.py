"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has 64 bits.  Two fingerprints link when at most ``radius`` bits
differ.  Candidates meet in buckets: the 64 bits are cut into b blocks and a bucket holds
the fingerprints that agree on b - radius of them, so that by the pigeonhole principle no
link is lost, whatever b is.  b grows with the logarithm of the number of fingerprints
(``blocks_for``), which keeps buckets of chance small.  Within buckets, bit planes are stored vertically: bit k of 64
fingerprints is one machine word.  For a lag d, the plane XORed with itself shifted by d
gives bit k of 64 differences at once; carry-save counters add them up, and a word is
abandoned when all of its 64 pairs exceed the radius.

Equal fingerprints are one representative (the smallest doc_id) before anything is
compared.  A bucket of more than ``block`` fingerprints is split into blocks, and every
pair of blocks is a task unit of its own (which compares across the two blocks only), so that
no task holds an unbounded bucket.  A unit returns a spanning forest of its links, never all pairs.

Defined results: null text counts as empty (fingerprint zero, linked like any other);
repeated rows are returned as often as they came; a row with a null doc_id links like any
other and never names a component, so that a class of such rows alone has a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    end = end[width - 1 :].tolist()
    n, digest = len(start), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(start[at : at + CHUNK], end[at : at + CHUNK], strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def marks(rows: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, h, fp) of rows (doc_id, text, _h): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_h").alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h long, fp long")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of docs."""
    return marks(docs.select("doc_id", "text", F.lit(0).cast("long").alias("_h")), width).drop("h")


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words + 2): bit k of value i is bit i of row k."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    bits = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    out = np.zeros((BITS, (-(-len(values) // 64) + 2) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view("<u8")


def _packed(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    bits = np.packbits(mask, bitorder="little")
    out[: len(bits)] = bits
    return out.view("<u8")


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bit-sliced counter exceeds limit."""
    more, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if limit >> k & 1:
            equal &= counter[k]
        else:
            more |= equal & counter[k]
            equal &= ~counter[k]
    return more


def close_at(plane: np.ndarray, valid: np.ndarray, lag: int, radius: int) -> np.ndarray:
    """Positions i for which valid[i] and values i, i + lag differ in at most radius bits."""
    live = _packed(valid, plane.shape[1] - 2)
    at = np.flatnonzero(live)
    live, far = live[at], np.zeros(len(at), np.uint64)
    skip, turn = divmod(lag, 64)
    width = (radius + 1).bit_length()
    counter = [np.zeros(len(at), np.uint64) for _ in range(width)]
    for k in range(BITS):
        row = plane[k]
        other = row[np.minimum(at + skip, len(row) - 1)]
        if turn:
            other = (other >> np.uint64(turn)) | (row[np.minimum(at + skip + 1, len(row) - 1)] << np.uint64(64 - turn))
        carry = row[at] ^ other
        for j in range(width):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        far |= carry  # the counter is full
        far |= _above(counter, radius)
        if k % 8 == 7:
            keep = (live & ~far) != 0
            if not keep.all():
                at, live, far = at[keep], live[keep], far[keep]
                counter = [c[keep] for c in counter]
                if not len(at):
                    return np.zeros(0, np.int64)
    bits = np.unpackbits((live & ~far).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def forest(values: np.ndarray, unit: np.ndarray, radius: int, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, root) of a spanning forest of the links among rows of the same unit; rows of a unit are adjacent.

    half: rows of unlike half are compared, of like half only where it is 0.
    """
    n, plane = len(values), planes(values)
    parent = np.arange(n)
    for lag in range(1, n):
        valid = np.zeros(n, bool)
        valid[: n - lag] = unit[lag:] == unit[: n - lag]
        if not valid.any():
            break
        if half is not None:
            valid[: n - lag] &= (half[lag:] == 0) | (half[lag:] != half[: n - lag])
        i = close_at(plane, valid, lag, radius)
        j = i + lag
        new = parent[i] != parent[j]
        if not new.any():
            continue
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def blocks_for(values: int, radius: int) -> int:
    """Blocks to cut fingerprints into, so that about eight of so many fingerprints share a bucket by chance at most."""
    blocks = radius + 2
    while blocks < 16 and BITS * (blocks - radius) // blocks + 3 < values.bit_length():
        blocks += 1
    return blocks


def _keys(blocks: int, radius: int) -> list[str]:
    """SQL for the bucket of each choice of blocks that have to agree."""
    cut = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    agree = blocks - radius
    out = []
    for t, chosen in enumerate(combinations(range(blocks), agree)):
        key, width = f"{t}L", 0
        for i in chosen:
            n = cut[i + 1] - cut[i]
            width += n
            key = f"(shiftleft({key}, {n}) | (shiftrightunsigned(fp, {cut[i]}) & {(1 << n) - 1}L))"
        if width + math.comb(blocks, agree).bit_length() > 63:
            raise ValueError("a bucket's key has no room in 63 bits")
        out.append(key)
    return out


def link(values: DataFrame, radius: int = 4, block: int = 2048, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between values (fp, all distinct) that reach every link within the radius."""
    spark = values.sparkSession
    blocks = blocks or blocks_for(values.count(), radius)
    spread = values.select(F.explode(F.expr(f"array({', '.join(_keys(blocks, radius))})")).alias("k"), "fp")
    counts = common.materialize(spread.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "simhash-buckets")
    parts = F.ceil(F.col("c") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    units = (
        spread.join(counts, "k")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0).alias("half"), "fp")
    )
    dealt = units.repartition(common.partitions(spark), "k", "x", "y").sortWithinPartitions("k", "x", "y", "half", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(k, x, y, half, fp):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            i, root = forest(fp.view(np.uint64), np.cumsum(new), radius, half)
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < CHUNK:
                continue
            k, x, y, half, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            last = (k == k[-1]) & (x == x[-1]) & (y == y[-1])
            cut = int(np.argmax(last))  # the last unit may go on in the next batch
            if cut:
                yield solved(k[:cut], x[:cut], y[:cut], half[:cut], fp[:cut])
            held = [[c[cut:] for c in (k, x, y, half, fp)]]
        if held:
            yield solved(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(values: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, class): the smallest fingerprint that each of values (fp, all distinct) reaches."""
    found = common.components(link(values.select("fp"), radius), "simhash-cc")
    out = values.select("fp").join(found, F.col("fp") == F.col("node"), "left")
    return common.materialize(out.select("fp", F.coalesce("component", "fp").alias("class")), "simhash-classes")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    marked = common.materialize(fingerprints(docs, width), "simhash-fp")
    values = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-values")
    found = values.join(classes(values, radius), "fp")
    names = found.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = common.materialize(found.join(names, "class").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest doc_id.

    Rows without a doc_id come last, and of rows with one doc_id the one with the smallest hash of
    its columns stays; rows that share a doc_id and aren't alike are documents of their own.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns).withColumn("_h", F.xxhash64(*columns))
    marked = common.materialize(marks(rows), "simhash-fp")
    values = common.materialize(marked.select("fp").distinct(), "simhash-values")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = marked.join(classes(values), "fp").groupBy("class").agg(F.min(order).alias("first"))
    first = common.materialize(first.select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_first")), "simhash-first")
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("n_chars"))  # of rows that are equal, one
    return kept.withColumn("_nth", nth).where("_nth = 1").select(*columns)
