"""Git as a source: diffs, blobs, log and status, fetched on the driver with a deadline and handed on as rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEADLINE = 10.0


def git(root: str, *args: str, deadline: float = DEADLINE) -> str | None:
    """Output of a git command, or None if it fails or is late."""
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=deadline, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode("utf-8", "replace") if run.returncode in (0, 1) and (run.returncode == 0 or "--no-index" in args) else None


def diff(spark: SparkSession, root: str, ref: str | None = None, staged: bool = False, files: tuple[str, str] | None = None) -> DataFrame:
    """patch_id, text: uncommitted changes, staged ones, those of a ref or range, or between two files."""
    args = ["diff", "--no-color", "--find-renames"]
    args += ["--no-index", "--", *files] if files else ["--staged"] if staged else [ref or "HEAD"]
    return spark.createDataFrame([(0, git(root, *args) or "")], "patch_id long, text string")


def blob(root: str, ref: str, path: str) -> str | None:
    return git(root, "show", f"{ref}:{path}")


def sides(spark: SparkSession, root: str, paths: list[str], old: str = "HEAD", new: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, text) before and after; after is the working tree unless a ref is given."""

    def here(path: str) -> str | None:
        try:
            with open(f"{root}/{path}", encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    take = lambda get: spark.createDataFrame([(p, t) for p in paths if (t := get(p)) is not None], "path string, text string")
    return take(lambda p: blob(root, old, p)), take(lambda p: blob(root, new, p) if new else here(p))


def log(spark: SparkSession, root: str, span: str, n: int = 20) -> DataFrame:
    """commit, time, subject, author of a range, newest first."""
    out = git(root, "log", f"-n{n}", "--format=%H %at %s%x00%an", span) or ""
    raw = spark.createDataFrame([(line,) for line in out.splitlines() if line], "line string")
    head = F.substring_index("line", "\x00", 1)
    return raw.select(
        F.substring_index(head, " ", 1).alias("commit"), F.timestamp_seconds(F.regexp_extract(head, r"^\S+ (\d+)", 1).cast("long")).alias("time"),
        F.regexp_extract(head, r"^\S+ \d+ (.*)$", 1).alias("subject"), F.substring_index("line", "\x00", -1).alias("author"),
    )


def history(spark: SparkSession, root: str, span: str, n: int = 20) -> DataFrame:
    """patch_id (0 for the newest), commit, text: the patch of each commit of a range, for diff.diff_lines."""
    commits = (git(root, "log", f"-n{n}", "--format=%H", span) or "").split()
    rows = [(i, c, git(root, "show", "--no-color", "--find-renames", "--format=", c) or "") for i, c in enumerate(commits)]
    return spark.createDataFrame(rows, "patch_id long, commit string, text string")


def status(root: str, deadline: float = 0.2) -> tuple[str | None, int | None]:
    """Branch and number of changed files; None for what is late."""
    branch, changed = git(root, "rev-parse", "--abbrev-ref", "HEAD", deadline=deadline), git(root, "status", "--porcelain", deadline=deadline)
    return branch and branch.strip(), None if changed is None else len(changed.splitlines())
