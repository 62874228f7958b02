"""Removal of repeated passages on a compacted de Bruijn graph of words.

A window of ``width`` consecutive words is an edge between its first and its last
width - 1 words.  A word goes if an edge that covers it also starts in a document with a
smaller doc_id.

1. Anchors: of the ``short``-word k-mers in a window, the one with the smallest hash (the
   first of equals).  It depends on the window's words alone, so a repeated edge has a
   repeated anchor.  The edges of a document that follow each other and share an anchor are a
   nonbranching path, and one row: its anchor's hash and the hash of all of its words.
2. Only paths whose anchor is in two documents at least go on.  Paths are joined to their
   first occurrence, in the smallest document: all edges of later occurrences are repeated.
3. Where an anchor has paths with unlike words, the first occurrences of those paths are opened
   into edges, which are joined to their first occurrence in the same way.  What is found
   holds for all occurrences of a path in its smallest document.
4. Paths and edges that follow each other in a document and in their source compact to spans
   with source coordinates.
5. The words at a span's source coordinates go to its document, ``CELL`` words at a time, and
   are compared with its own, word for word.  If any differ, unlike paths had equal hashes, and
   all is judged again with another hash; after as many attempts as there are hashes, this
   is an error.

The joins sort and merge at every size, so that small tables plan like large ones; a path
that a third of all documents share is one row on the other side of its join.  Texts are
shuffled twice, to open paths and to remove spans.

Defined results: null text has no words; a text of fewer than width words loses nothing; a
null doc_id neither loses words nor is a source; rows with one doc_id are judged each by
its own text, and never by one another; equal rows get equal results; an empty table gives
no rows; other columns are ignored.  Kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDTH, SHORT, CELL = 50, 25, 64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd; one for each attempt
WHOLE = ((1 << 64) - 1,) * len(BASES)
PIECE, BYTES = 1 << 20, 8 << 20


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_powers = [Powers(b) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of width consecutive words, given the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers[which].get(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return mixed((sums[width:] - sums[:-width]) * down[:n])


def stretches(words: np.ndarray, start: np.ndarray, length: np.ndarray, which: int, mask: int) -> np.ndarray:
    """Hash of the words from each start on, as many as length says, given the words' hashes."""
    up, down = _powers[which].get(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
    return mixed((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64)) & np.uint64(mask)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(codes: np.ndarray, width: int = WIDTH, short: int = SHORT) -> np.ndarray:
    """The place of each window's anchor."""
    n, span = len(codes) - width + 1, width - short + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    kmer, out = rolling(codes, short), np.empty(n, np.int64)
    for at in range(0, n, PIECE):
        end = min(n, at + PIECE)
        view = np.lib.stride_tricks.sliding_window_view(kmer[at : end + span - 1], span)
        out[at:end] = view.argmin(1) + np.arange(at, end)
    return out


def paths(codes: np.ndarray, width: int = WIDTH, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first edge, number of edges) of a text's paths, given its words' hashes."""
    place = anchors(codes, width, short)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return rolling(codes, short)[place[start]], start, np.diff(np.r_[start, len(place)])


def _seen(docs: DataFrame, width: int, short: int, which: int, mask: int) -> DataFrame:
    """(h, s, doc_id, t, start, n): the paths of every document; h is the anchor's hash, s that of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc_id, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                codes = hashed((text.as_py() or b"").split())
                if len(codes) < width:
                    continue
                h, start, n = paths(codes, width, short)
                found = stretches(codes, start, n + (width - 1), which, mask)
                for column, x in zip(out, (h.view(np.int64), found.view(np.int64), np.full(len(h), doc_id), np.full(len(h), t, np.int32), start.astype(np.int32), n.astype(np.int32)), strict=True):
                    column.append(x)
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(out, kinds, strict=True)], ["h", "s", "doc_id", "t", "start", "n"])

    return docs.mapInArrow(run, "h long, s long, doc_id long, t int, start int, n int")


def _opened(rows: DataFrame, width: int, which: int, mask: int) -> DataFrame:
    """Of rows (doc_id, t, text, asked: paths): the edges of mixed paths (h, s, w, doc_id, t, pos, off), and all words of paths (doc_id, t, cell, words)."""
    names = ["h", "s", "w", "doc_id", "t", "pos", "off", "cell", "words"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)

        def cells(found: list[tuple]) -> pa.RecordBatch:
            ids, ts, at, words = zip(*found, strict=True)
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.array(ids, pa.int64()), pa.array(ts, pa.int32())] + [pa.nulls(n, pa.int32())] * 2 + [pa.array(at, pa.int32()), pa.array(words, pa.string())], names)

        for batch in batches:
            some, n_some, texts, n_texts = [], 0, [], 0
            for doc_id, t, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3), strict=True):
                words = (text.as_py() or b"").split()
                field = asked.values
                start, n = (field.field(k).to_numpy() for k in ("start", "n"))
                mixed_ = field.field("mixed").to_numpy(zero_copy_only=False)
                if mixed_.any():
                    w = rolling(hashed(words), width, which) & np.uint64(mask)
                    own = np.flatnonzero(mixed_)
                    each = np.repeat(own, n[own])
                    off = np.arange(len(each)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    pos = start[each] + off
                    h, s = (field.field(k).to_numpy()[each] for k in ("h", "s"))
                    some.append((h, s, w[pos].view(np.int64), np.full(len(each), doc_id), np.full(len(each), t, np.int32), pos.astype(np.int32), off.astype(np.int32)))
                    n_some += len(each)
                mark = np.zeros(len(words) // CELL + 2, np.int64)
                np.add.at(mark, start // CELL, 1)
                np.add.at(mark, (start + n + (width - 2)) // CELL + 1, -1)
                for cell in np.flatnonzero(np.cumsum(mark)).tolist():
                    texts.append((doc_id, t, cell, b" ".join(words[cell * CELL : (cell + 1) * CELL]).decode("utf-8")))
                    n_texts += len(texts[-1][3])
                if n_some >= PIECE:
                    yield edges(some)
                    some, n_some = [], 0
                if n_texts >= BYTES:
                    yield cells(texts)
                    texts, n_texts = [], 0
            if some:
                yield edges(some)
            if texts:
                yield cells(texts)

    schema = "h long, s long, w long, doc_id long, t int, pos int, off int, cell int, words string"
    return rows.select("doc_id", "t", "text", "asked").mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t and text; t is a hash that tells rows with one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("t"), text.alias("text"))


def spans(docs: DataFrame, width: int = WIDTH, short: int = SHORT, which: int = 0, mask: int = WHOLE[0]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, start, length, source, source_t, source_start): passages repeated from a smaller document, as far as hashes
    tell; and (source, source_t, cell, words): the words of the sources.  Both are written tables."""
    docs = _keyed(docs).where("doc_id is not null")
    seen = common.materialize(_seen(docs, width, short, which, mask), "paths")
    shared = common.materialize(seen.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "shared-anchors")
    some = common.materialize(seen.join(shared.hint("merge"), "h"), "shared-paths")
    common.drop(seen, shared)
    # one row for each path: its first occurrence
    first = some.groupBy("h", "s").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n"))
    first = common.materialize(first.select("h", "s", "first.*", "last", "n"), "first-paths")
    mixed_ = common.materialize(first.groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("a"), F.max("last").alias("b")).where("c > 1 AND a < b").select("h", F.lit(True).alias("mixed")), "mixed-anchors")
    asked = first.join(mixed_.hint("merge"), "h", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))).where("mixed OR doc_id < last")
    asked = asked.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "h", "s", "mixed")).alias("asked"))
    asked = common.materialize(asked, "asked-paths")
    common.drop(mixed_)
    opened = common.materialize(_opened(docs.join(asked.hint("merge"), ["doc_id", "t"]), width, which, mask), "opened-paths")
    common.drop(asked)
    edges = opened.where("cell IS NULL").select("h", "s", "w", "doc_id", "t", "pos", "off")
    origin = edges.groupBy("h", "w").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    origin = origin.select("h", "w", F.col("first.doc_id").alias("source"), F.col("first.t").alias("source_t"), F.col("first.pos").alias("source_start"))
    origin = common.materialize(origin, "first-edges")
    found = edges.join(origin.hint("merge"), ["h", "w"]).where("source < doc_id").select("h", "s", "off", "source", "source_t", "source_start").distinct()
    found = common.materialize(found, "repeated-edges")
    common.drop(origin)
    names = ["doc_id", "t", "start", "n", "source", "source_t", "source_start"]
    own = first.select("h", "s", F.col("doc_id").alias("source"), F.col("t").alias("source_t"), F.col("start").alias("source_start"), "last")
    later = some.join(own.where("source < last").drop("last").hint("merge"), ["h", "s"]).where("source < doc_id").select(*names)
    opens = found.select("h", "s").distinct()
    here = some.join(own.join(opens.hint("merge"), ["h", "s"]).select("h", "s", F.col("source").alias("_id")).hint("merge"), ["h", "s"]).where("doc_id = _id").select("h", "s", "doc_id", "t", "start").distinct()
    here = here.join(found.hint("merge"), ["h", "s"]).select("doc_id", "t", (F.col("start") + F.col("off")).alias("start"), F.lit(1).alias("n"), "source", "source_t", "source_start")
    parts = common.materialize(later.distinct().union(here.select(*names).distinct()), "repeated-paths")
    common.drop(some, first, found)
    lane = Window.partitionBy("doc_id", "t", "source", "source_t", "lag").orderBy("start")
    ends = F.max(F.col("start") + F.col("n")).over(lane.rowsBetween(Window.unboundedPreceding, -1))
    runs = parts.withColumn("lag", F.col("source_start") - F.col("start")).withColumn("new", F.coalesce((F.col("start") > ends).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(lane)).groupBy("doc_id", "t", "source", "source_t", "lag", "run")
    runs = runs.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start") + (width - 1)).alias("length"))
    out = common.materialize(runs.select("doc_id", "t", "start", "length", "source", "source_t", (F.col("start") + F.col("lag")).alias("source_start")), "spans")
    common.drop(parts)
    # a table of its own, so that a join with it can split a source that very many documents repeat
    cells = opened.where("cell IS NOT NULL").dropDuplicates(["doc_id", "t", "cell"])
    cells = common.materialize(cells.select(F.col("doc_id").alias("source"), F.col("t").alias("source_t"), "cell", "words"), "cells")
    common.drop(opened)
    return out, cells


def _judged(docs: DataFrame, width: int, short: int, which: int, mask: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept, unlike (whether a span's words differ from its source's) for every row of docs."""
    found, cells = spans(docs, width, short, which, mask)
    cell = F.explode(F.sequence(F.floor(F.col("source_start") / CELL).cast("int"), F.floor((F.col("source_start") + F.col("length") - 1) / CELL).cast("int")))
    pieces = found.withColumn("cell", cell).join(cells.hint("merge"), ["source", "source_t", "cell"], "left")
    at = F.col("cell") * CELL - F.col("source_start") + F.col("start")  # of the cell's first word in the document
    pieces = pieces.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("start", "length", at.alias("at"), "words")).alias("pieces"))
    pieces = common.materialize(pieces, "pieces")
    common.drop(found, cells)
    rows = _keyed(docs).join(pieces.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept, unlike = [], [], [], []
            for text, own in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                stay, wrong = np.ones(len(words), bool), False
                for p in own.as_py() or ():
                    a, b = max(p["start"], p["at"]), min(p["start"] + p["length"], p["at"] + CELL)
                    wrong |= p["words"] is None or words[a:b] != p["words"].encode().split()[a - p["at"] : b - p["at"]]
                    stay[a:b] = False
                total.append(len(words))
                gone.append(int((~stay).sum()))
                kept.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode("utf-8"))
                unlike.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(unlike, pa.bool_())], ["doc_id", "n_words", "n_removed", "kept", "unlike"])

    out = common.materialize(rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, unlike boolean"), "kept")
    common.drop(pieces)
    return out


def removed(docs: DataFrame, width: int = WIDTH, short: int = SHORT, masks: tuple[int, ...] = WHOLE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (its text without repeated passages).

    masks: the bits of hashes that count in each attempt.
    """
    for which, mask in enumerate(masks):
        found = _judged(docs, width, short, which, mask)
        if found.where("unlike").isEmpty():
            return found.drop("unlike")
        common.drop(found)
    raise ValueError("unlike passages have equal hashes in every attempt")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what is left of every document."""
    found = removed(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) t),
f AS (SELECT s, min(doc_id) AS m FROM p GROUP BY s),
g AS (SELECT p.doc_id, p.i FROM p JOIN f USING (s) WHERE m < p.doc_id),
x AS (SELECT DISTINCT doc_id, i + k AS j FROM g, (SELECT unnest(range(50)) AS k) r),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.j = x.j GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
