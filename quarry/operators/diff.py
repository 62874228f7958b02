"""Structural differences: matching symbol versions, unified diffs, attribution of lines, conflicts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.cuts import cut

IDENTITY = ["path", "kind", "parent_path", "name"]
LIKE = 0.8


def _side(versions: DataFrame, side: str) -> DataFrame:
    return versions.where(F.col("side") == side).drop("side")


def match_versions(versions: DataFrame) -> DataFrame:
    """Symbol changes between sides old and new: (kind, name, change, confidence, score, old_name, n_ambiguous, old_line, new_line, old_sig, new_sig).

    versions: side, path, kind, parent_path, name, start_line, signature, content_hash, structural_hash, source_text.
    1. Same identity: overloads pair by content first, then by place.  2. Same structure, one on each
    side: renamed; more than one: ambiguous.  3. Same kind, similar length and text: best pairs first.
    """
    old, new = _side(versions, "old"), _side(versions, "new")
    nth = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("start_line"))
    number = lambda d: d.withColumn("id", F.xxhash64("path", "kind", "parent_path", "name", "start_line"))
    old, new = cut(number(old)), cut(number(new))

    def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        x = a.withColumn("nth", nth(keys)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "nth", F.struct("*").alias("old"))
        y = b.withColumn("nth", nth(keys)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "nth", F.struct("*").alias("new"))
        on = x["nth"] == y["nth"]
        for i in range(len(keys)):
            on = on & x[f"k{i}"].eqNullSafe(y[f"k{i}"])
        return x.join(y, on).select("old", "new")

    def left(d: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
        return d.join(pairs.select(F.col(f"{side}.id").alias("id")), "id", "left_anti")

    same = cut(paired(old, new, [*IDENTITY, "content_hash"]))
    old1, new1 = cut(left(old, same, "old")), cut(left(new, same, "new"))
    moved = cut(paired(old1, new1, IDENTITY))
    old2, new2 = cut(left(old1, moved, "old")), cut(left(new1, moved, "new"))
    key = ["path", "kind", "structural_hash"]
    n_of = lambda d, s: d.groupBy(*key).agg(F.count("*").alias(s))
    counts = n_of(old2, "n_old").join(n_of(new2, "n_new"), key)
    single = counts.where("n_old = 1 AND n_new = 1").select(*key)
    renamed = cut(paired(old2.join(single, key, "left_semi"), new2.join(single, key, "left_semi"), key))
    old3, new3 = left(old2, renamed, "old"), left(new2, renamed, "new")
    unclear = counts.where("n_old > 1 OR n_new > 1").select(*key, F.greatest("n_old", "n_new").alias("n_ambiguous"))
    fuzzy = cut(fuzzy_pairs(old3.join(unclear, key, "left_anti"), new3.join(unclear, key, "left_anti")))
    old4, new4 = left(old3, fuzzy, "old"), left(new3, fuzzy, "new")
    sig = F.when(~F.col("old.signature").eqNullSafe(F.col("new.signature")), "signature_changed").otherwise("body_changed")
    none = F.lit(None)

    def out(d, change, confidence, score=none, ambiguous=none, o="old", n="new"):
        get = lambda s, c: F.col(f"{s}.{c}") if s else none
        any_ = n or o
        return d.select(
            get(any_, "path").alias("path"), get(any_, "kind").alias("kind"), get(any_, "name").alias("name"), change.alias("change"), confidence.alias("confidence"), score.cast("double").alias("score"),
            get(o, "name").cast("string").alias("old_name"), ambiguous.cast("long").alias("n_ambiguous"), get(o, "start_line").cast("int").alias("old_line"), get(n, "start_line").cast("int").alias("new_line"),
            get(o, "signature").cast("string").alias("old_sig"), get(n, "signature").cast("string").alias("new_sig"),
        )

    wrap = lambda d, s: d.join(unclear, key, "left").select(F.struct(*[c for c in d.columns]).alias(s), "n_ambiguous")
    doubt = F.when(F.col("n_ambiguous").isNotNull(), "ambiguous").otherwise("exact")
    return (
        out(same, F.lit("unchanged"), F.lit("exact")).union(out(moved, sig, F.lit("exact"))).union(out(renamed, F.lit("renamed"), F.lit("structural")))
        .union(out(fuzzy, F.lit("renamed"), F.lit("fuzzy"), F.col("score")))
        .union(out(wrap(old4, "old"), F.lit("deleted"), doubt, ambiguous=F.col("n_ambiguous"), n=None)).union(out(wrap(new4, "new"), F.lit("added"), doubt, ambiguous=F.col("n_ambiguous"), o=None))
    )


def fuzzy_pairs(old: DataFrame, new: DataFrame, least: float = LIKE) -> DataFrame:
    """One-to-one pairs (old, new, score) within a file and kind, the most similar texts first.

    Candidates have lengths within the ratio; the greedy choice runs for each file and kind, whose symbols are few.
    """
    a, b = old.select(F.struct("*").alias("old")), new.select(F.struct("*").alias("new"))
    la, lb = F.octet_length("old.source_text"), F.octet_length("new.source_text")
    near = a.join(b, (F.col("old.path") == F.col("new.path")) & (F.col("old.kind") == F.col("new.kind")) & (F.least(la, lb) >= least * F.greatest(la, lb)))
    scored = near.withColumn("score", likeness(F.col("old.source_text"), F.col("new.source_text"))).where(F.col("score") >= least)
    order = F.struct((-F.col("score")).alias("s"), F.col("old.start_line").alias("o"), F.col("new.start_line").alias("n"), F.col("old.id").alias("a"), F.col("new.id").alias("b"))
    grouped = scored.groupBy(F.col("old.path").alias("p"), F.col("old.kind").alias("k")).agg(F.array_sort(F.collect_list(order)).alias("c"))
    start = F.array().cast("array<struct<s:double,o:int,n:int,a:bigint,b:bigint>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    step = lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x.cast("struct<s:double,o:int,n:int,a:bigint,b:bigint>")))).otherwise(acc)
    chosen = grouped.select(F.explode(F.aggregate("c", start, step)).alias("x")).select("x.a", "x.b")
    return scored.join(chosen, (F.col("old.id") == F.col("a")) & (F.col("new.id") == F.col("b"))).select("old", "new", "score")


def pair_counts(text: str) -> tuple[Counter, int]:
    """Character pairs with their counts, and how many there are; as T.bigrams."""
    s = re.sub(r"\s+", "", text, flags=re.ASCII)
    return Counter(map("".join, pairwise(s))), max(0, len(s) - 1)


def scores(a: Iterable[str], b: Iterable[str]) -> list[float]:
    """Sorensen-Dice of character pairs of texts side by side; 1 for two without any."""
    counts, out = lru_cache(4096)(pair_counts), []
    for ta, tb in zip(a, b, strict=True):
        (ca, na), (cb, nb) = counts(ta), counts(tb)
        if len(cb) < len(ca):
            ca, cb = cb, ca
        shared = sum(min(n, cb[g]) for g, n in ca.items() if g in cb)
        out.append(2.0 * shared / (na + nb) if na + nb else 1.0)
    return out


def likeness(a: Column, b: Column) -> Column:
    """scores as a column, in Arrow batches."""
    return F.pandas_udf(lambda x, y: pd.Series(scores(x.fillna(""), y.fillna(""))), "double")(a, b)


def similar_texts(old: DataFrame, new: DataFrame, ratio: float = LIKE) -> DataFrame:
    """(a, b, score): Sorensen-Dice of all pairs of an old and a new item (id, text) whose lengths are within the ratio, pairs without a shared character pair too.

    Lengths are cut into bands as wide as the ratio, so that a partner is in the same band or beside it: an equal join, not one of all pairs.
    """
    x, y = old.select(F.col("id").alias("a"), F.col("text").alias("ta")), new.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    la, lb = F.octet_length("ta"), F.octet_length("tb")
    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(-math.log(ratio))).cast("int")
    x = x.withColumn("band", F.explode(F.array(*(band(la) + k for k in (-1, 0, 1)))))
    near = x.join(y.withColumn("_band", band(lb)), (F.col("band") == F.col("_band")) & (F.least(la, lb) >= ratio * F.greatest(la, lb)))

    return near.select("a", "b", likeness(F.col("ta"), F.col("tb")).alias("score"))


def moves(changes: DataFrame) -> DataFrame:
    """A symbol deleted in one file and added in another, each once for its kind and name, is moved; both rows name the file it left."""
    key = ["kind", "name"]
    side = lambda c: changes.where(F.col("change") == c).groupBy(*key).agg(F.count("*").alias(f"n_{c}"), F.min("path").alias(f"{c}_path"))
    pairs = side("deleted").join(side("added"), key).where("n_deleted = 1 AND n_added = 1 AND deleted_path <> added_path").select(*key, F.col("deleted_path").alias("old_path"))
    out = changes.join(pairs, key, "left")
    is_move = F.col("old_path").isNotNull() & F.col("change").isin("deleted", "added")
    return out.withColumns({"change": F.when(is_move, "moved").otherwise(F.col("change")), "old_path": F.when(is_move, F.col("old_path"))})


def signature_warnings(changes: DataFrame) -> DataFrame:
    """Names whose signature changed more than once."""
    return changes.where("change = 'signature_changed'").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
LINES = "patch_id long, file_id int, path string, old_path string, status string, is_binary boolean, hunk_no int, idx int, kind string, content string, old_line int, new_line int"


def parse_diff(text: str) -> Iterator[tuple]:
    """Rows of a unified diff: one for each line of a hunk, and one without a line for a file that has none."""
    file: dict | None = None
    file_id, hunk, idx, old, new, rows = -1, -1, 0, 0, 0, 0

    def head() -> tuple:
        return (file_id, file["path"], file["old_path"], file["status"], file["binary"])

    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("diff --git "):
            if file is not None and not rows:
                yield (*head(), None, None, None, None, None, None)
            path = line.rpartition(" b/")[2]
            file = {"path": path, "old_path": None, "status": "modified", "binary": False}
            file_id, hunk, rows = file_id + 1, -1, 0
        elif file is None:
            continue
        elif m := HUNK.match(line):
            hunk, idx, old, new = hunk + 1, 0, int(m[1]), int(m[3])
        elif hunk < 0:
            if line.startswith("new file"):
                file["status"] = "added"
            elif line.startswith("deleted file"):
                file["status"] = "deleted"
            elif line.startswith("rename from "):
                file |= {"status": "renamed", "old_path": line[12:]}
            elif line.startswith("rename to "):
                file["path"] = line[10:]
            elif line.startswith("Binary files"):
                file["binary"] = True
        elif line.startswith(("--- ", "+++ ")) or line.startswith("@@"):
            hunk = -1 if line.startswith("@@") else hunk  # a malformed hunk is left out
        elif line[:1] in ("+", "-", " "):
            kind = {"+": "added", "-": "removed", " ": "context"}[line[0]]
            yield (*head(), hunk, idx, kind, line[1:], old if kind != "added" else None, new if kind != "removed" else None)
            idx, rows = idx + 1, rows + 1
            old, new = old + (kind != "added"), new + (kind != "removed")
    if file is not None and not rows:
        yield (*head(), None, None, None, None, None, None)


def diff_lines(patches: DataFrame) -> DataFrame:
    """Lines of patches (patch_id, text), see parse_diff."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(pid, *row) for pid, text in zip(frame["patch_id"], frame["text"], strict=True) for row in parse_diff(text or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("file_id", "hunk_no", "idx", "old_line", "new_line")})

    return patches.select("patch_id", "text").mapInPandas(run, LINES)


def attribute(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Diff lines within symbols: added and context lines by new line, removed ones by old line among deleted symbols."""
    s = symbols.select(F.col("path").alias("_path"), "name", "kind", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), "change")
    here = F.when(F.col("kind_") == "removed", F.col("old_line")).otherwise(F.col("new_line"))
    r = rows.withColumnRenamed("kind", "kind_")
    on = (F.col("path") == F.col("_path")) & (here >= F.col("_a")) & (here <= F.col("_b")) & ((F.col("kind_") == "removed") == (F.col("change") == "deleted"))
    return r.join(s, on).select("path", "hunk_no", "idx", F.col("kind_").alias("line_kind"), "content", "old_line", "new_line", "name", "kind")


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """Diff lines or changes of the files whose path ends in the scope; file:function also keeps one function's."""
    file, _, name = scope.partition(":")
    found = rows.where(F.endswith("path", F.lit(file)))
    return found.where(F.col("name") == name) if name else found


def holding(changes: DataFrame, rows: DataFrame, q: str) -> DataFrame:
    """Changes of symbols whose name holds q in any case, or among whose diff lines (attributed: path, name, content) one does."""
    low = F.lit(q.lower())
    by_line = rows.where(F.contains(F.lower("content"), low)).select("path", "name")
    by_name = changes.where(F.contains(F.lower("name"), low)).select("path", "name")
    return changes.join(by_line.union(by_name).distinct(), ["path", "name"], "left_semi")


def with_files(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds what a diff says of the file: status, old_path of the file, is_binary; the first entry of a path counts."""
    first = rows.groupBy(F.col("path").alias("_path")).agg(F.min_by(F.struct("status", F.col("old_path").alias("file_old_path"), "is_binary"), "file_id").alias("_f"))
    return changes.join(first, F.col("path") == F.col("_path"), "left").select(*changes.columns, "_f.*")


# The mark and the label of each change, and the mark of an ambiguous match.
MARKS = {"added": "[+]", "deleted": "[-]", "body_changed": "[~]", "signature_changed": "[~:sig]", "renamed": "[→]", "moved": "[↦]", "renamed_moved": "[→↦]", "unchanged": "[ ]"}
CHANGE_LABELS = {
    "added": "added", "deleted": "deleted", "body_changed": "body changed", "signature_changed": "signature changed", "renamed": "renamed", "moved": "moved",
    "renamed_moved": "renamed and moved", "unchanged": "unchanged",
}
AMBIGUOUS = "[?→]"


def marker(change: Column, confidence: Column) -> Column:
    """The mark that a change's line begins with."""
    marks = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    return F.when(confidence == "ambiguous", AMBIGUOUS).otherwise(F.element_at(marks, change))


def change_label(change: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CHANGE_LABELS.items() for x in pair)), change)


def first_of(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row for each key, at its first place, in order of those: distinct that keeps an order."""
    return rows.groupBy(*key).agg(F.min(pos).alias(pos)).orderBy(pos)


def diff_counts(rows: DataFrame) -> DataFrame:
    """files, insertions, deletions of each patch."""
    return rows.groupBy("patch_id").agg(F.count_distinct("file_id").alias("files"), F.count_if(F.col("kind") == "added").alias("insertions"), F.count_if(F.col("kind") == "removed").alias("deletions"))


def hunk_numbers(rows: DataFrame) -> DataFrame:
    """Adds old_line and new_line to hunk lines (hunk_id, idx, kind, old_start, new_start) by running counts."""
    over = Window.partitionBy("hunk_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(over), F.lit(0))
    old = F.when(F.col("kind") != "added", F.col("old_start") + count(("context", "removed")))
    new = F.when(F.col("kind") != "removed", F.col("new_start") + count(("context", "added")))
    return rows.withColumn("old_line", old).withColumn("new_line", new)


def conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Conflict blocks of files by lines: key..., start, middle (the last separator), end."""
    over = Window.partitionBy(*key).orderBy("line")
    mark = F.when(F.startswith("text", F.lit("<<<<<<<")), 1).otherwise(0)
    rows = rows.withColumn("_block", F.sum(mark).over(over)).where("_block > 0")
    by = rows.groupBy(*key, "_block")
    found = by.agg(F.min("line").alias("start"), F.min(F.when(F.startswith("text", F.lit(">>>>>>>")), F.col("line"))).alias("end"), F.collect_list(F.when(F.startswith("text", F.lit("=======")), F.col("line"))).alias("_seps"))
    middle = F.array_max(F.filter("_seps", lambda x: x < F.col("end")))
    return found.where("end IS NOT NULL").select(*key, "start", middle.alias("middle"), "end").where("middle IS NOT NULL")


def edit_offsets(edits: DataFrame, key: list[str]) -> DataFrame:
    """Adds offset: by how much earlier edits (start, end, new_lines) of a file have moved an edit; and overlaps: whether it begins before the last one ends."""
    by = Window.partitionBy(*key).orderBy("start")
    delta = F.col("new_lines") - (F.col("end") - F.col("start") + 1)
    offset = F.coalesce(F.sum(delta).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edits.withColumn("offset", offset).withColumn("overlaps", F.coalesce(F.lag("end").over(by) >= F.col("start"), F.lit(False)))


def verified(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ok: whether the line at an edit's start still has the hash that the edit names."""
    now = rows.select(F.col("path").alias("_path"), F.col("line").alias("_line"), T.fnv12(F.col("text")).alias("_hash"))
    out = edits.join(now, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_line")), "left")
    return out.withColumn("ok", F.coalesce(F.col("_hash") == F.col("start_hash"), F.lit(False))).drop("_path", "_line", "_hash")


def new_errors(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Errors after an edit beyond as many equal ones before it; the later ones stay."""
    had = before.groupBy(*key).agg(F.count("*").alias("_had"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    return after.withColumn("_nth", nth).join(had, key, "left").where(F.col("_nth") > F.coalesce("_had", F.lit(0))).drop("_nth", "_had")
