"""Explicit sinks for edited files: create, overwrite and append, each file by rename; batches are checked first."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BATCH = 20
MODES = ("create", "overwrite", "append")


def problems(batch: DataFrame, root: str, most: int = BATCH) -> list[str]:
    """What is wrong with a batch (path, text): too many files, a path twice, a path outside of the root."""
    rows = batch.select(T.normalized_path(F.col("path")).alias("key"), "path").limit(most + 1).collect()
    out = [f"more than {most} files"] if len(rows) > most else []
    keys = [r["key"] for r in rows]
    out += [f"twice: {k}" for k in sorted({k for k in keys if keys.count(k) > 1})]
    return out + [f"outside of {root}: {r['path']}" for r in rows if r["key"].startswith(("../", "/")) or r["key"] == ".."]


def write(path: str, text: str, mode: str = "create") -> None:
    """create refuses an existing file, overwrite replaces one, append adds; none follows a symbolic link."""
    if os.path.islink(path):
        raise OSError(f"a symbolic link: {path}")
    if mode == "create" and os.path.exists(path):
        raise FileExistsError(path)
    if mode == "append":
        with open(path, "a", encoding="utf-8", newline="") as f:
            f.write(text)
        return
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(part, os.stat(path).st_mode)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_back(batch: DataFrame, root: str, mode: str = "overwrite") -> int:
    """Writes a checked batch of at most BATCH files (path, text) from the driver; returns how many.

    A column mode gives a file its own mode; where it is null or missing, mode holds.
    """
    if found := problems(batch, root):
        raise ValueError("; ".join(found))
    own = F.col("mode") if "mode" in batch.columns else F.lit(None).cast("string")
    rows = batch.select("path", "text", F.coalesce(own, F.lit(mode)).alias("mode")).limit(BATCH).collect()
    if unknown := sorted({r["mode"] for r in rows} - {*MODES}):
        raise ValueError(f"modes are {', '.join(MODES)}, not {', '.join(unknown)}")
    for r in rows:
        write(os.path.join(root, r["path"]), r["text"], r["mode"])
    return len(rows)


def as_json(query: str, rows: DataFrame) -> DataFrame:
    """json: a row of a result as one JSON object with the query it answers, for spark.write.text or a pager."""
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.struct(*rows.columns).alias("result"))).alias("json"))
