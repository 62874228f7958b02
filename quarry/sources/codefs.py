"""A directory tree as a table of files: a Python data source, for trees that all executors can read.

spark.dataSource.register(TreeSource)
spark.read.format("tree").option("path", "/shared/src").load()

Columns: path (relative), name, ext, dir, length, mtime, content (null for what is no regular
file or larger than max_bytes).  Hidden files are included, symbolic links are followed
(each real directory once), and directories with a name in SKIP are pruned before they are
listed.  A partition is a batch of files of about ``batch_bytes``.  Options: path, depth,
max_bytes, batch_bytes, hidden (true), links (true: follow linked directories), device (false:
true keeps to the root's file system), ignore (false: true honours .gitignore files), glob (!
negates).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

from ..operators.search import glob_pattern

# Directories that are never listed.
SKIP = (
    ".git", "node_modules", "target", "dist", "build", "__pycache__", ".pycache", "vendor", ".next", ".nuxt", "coverage", ".cache", ".tox", ".venv", ".eggs",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", ".turbo", ".parcel-cache", ".svelte-kit", "out", ".output", ".vercel", ".netlify", ".gradle", ".idea",
    ".scala-build", ".bloop", ".metals",
)
SCHEMA = "path string, name string, ext string, dir string, length long, mtime timestamp, content binary"


def ignore_rules(file: str, home: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern of relative paths, for directories only, negated) of an ignore file in the folder home."""
    out = []
    with open(file, encoding="utf-8", errors="replace") as f:
        for line in f:
            rule = line.rstrip("\n").rstrip()
            if not rule or rule.startswith("#"):
                continue
            negated, rule = rule.startswith("!"), rule.removeprefix("!")
            folder, rule = rule.endswith("/"), rule.rstrip("/")
            at = rule.removeprefix("/") if "/" in rule else f"**/{rule}"
            pattern = glob_pattern(at)
            out.append((re.compile("^" + re.escape(home) + pattern.removeprefix("^")), folder, negated))
    return out


def ignored(path: str, is_dir: bool, rules: tuple) -> bool:
    """Whether the last rule that knows a path leaves it out."""
    hit = [not negated for pattern, folder, negated in rules if (is_dir or not folder) and pattern.search(path)]
    return bool(hit) and hit[-1]


class Batch(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.depth = int(options.get("depth", "0"))
        self.max_bytes = int(options.get("max_bytes", str(1 << 31)))
        self.batch_bytes = int(options.get("batch_bytes", str(32 << 20)))
        self.hidden, self.links = (options.get(k, "true").lower() != "false" for k in ("hidden", "links"))
        self.device, self.ignore = (options.get(k, "false").lower() == "true" for k in ("device", "ignore"))
        glob = options.get("glob", "")
        self.negate, self.glob = glob.startswith("!"), re.compile(glob_pattern(glob.removeprefix("!"))) if glob else None
        self.most, self.ext = None, None

    def walk(self) -> Iterator[tuple[str, int]]:
        """(relative path, size) of the files that pass name, depth and size."""
        stack, seen = [(self.root, "", ())], {os.path.realpath(self.root)}
        home = os.stat(self.root).st_dev if self.device else None
        while stack:
            folder, rel, rules = stack.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            if self.ignore and any(e.name == ".gitignore" for e in entries):
                rules = (*rules, *ignore_rules(os.path.join(folder, ".gitignore"), rel))
            for e in entries:
                if not self.hidden and e.name.startswith("."):
                    continue
                path = f"{rel}{e.name}"
                try:
                    if rules and ignored(path, e.is_dir(), rules):
                        continue
                    if e.is_dir(follow_symlinks=self.links):
                        real = os.path.realpath(e.path)
                        if e.name not in SKIP and real not in seen and not (self.depth and path.count("/") + 1 >= self.depth) and (home is None or e.stat().st_dev == home):
                            seen.add(real)
                            stack.append((e.path, f"{path}/", rules))
                    elif e.is_file():
                        size = e.stat().st_size
                        hit = self.glob is None or bool(self.glob.search(path) or self.glob.search(e.name)) != self.negate
                        if hit and (self.most is None or size <= self.most) and (self.ext is None or e.name.rpartition(".")[2] == self.ext):
                            yield path, size
                except OSError:
                    continue

    def partitions(self) -> list[Batch]:
        out, files, size = [], [], 0
        for path, n in self.walk():
            files.append(path)
            size += n
            if size >= self.batch_bytes or len(files) >= 10_000:
                out.append(Batch(files))
                files, size = [], 0
        return out + ([Batch(files)] if files or not out else [])

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path in partition.files:
            full = os.path.join(self.root, path)
            try:
                stat = os.stat(full)
                with open(full, "rb") as f:
                    content = f.read() if stat.st_size <= self.max_bytes else None
            except OSError:
                continue
            folder, _, name = path.rpartition("/")
            stem, dot, ext = name.rpartition(".")
            yield path, name, ext if dot and stem else "", folder, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), content


class PushingReader(TreeReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Size limits and an extension are taken here, before a file is opened."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if isinstance(f, (LessThan, LessThanOrEqual)) and column == ("length",):
                self.most = min(f.value - isinstance(f, LessThan), self.most if self.most is not None else f.value)
            elif isinstance(f, EqualTo) and column == ("ext",):
                self.ext = f.value
            yield f  # Spark tests them again


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return PushingReader(self.options) if self.options.get("pushdown") == "true" else TreeReader(self.options)


def tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tree").options(path=path, pushdown=push, **options).load()


def texts(files: DataFrame, lossy: bool = False) -> DataFrame:
    """path, text, length, mtime of files that are UTF-8 (with lossy: of all, replacing what is not), line ends unchanged."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if not lossy else F.make_valid_utf8(F.col("content").cast("string"))
    out = files.where("content IS NOT NULL").select("path", text.alias("text"), "length", "mtime")
    return out if lossy else out.where("text IS NOT NULL")


def readable_lines(files: DataFrame) -> DataFrame:
    """path, line, text of files (path, content) up to their first line that is not UTF-8."""
    each = files.where("content IS NOT NULL").select("path", F.posexplode(F.split(F.decode(F.col("content"), "ISO-8859-1"), "\n")).alias("line", "raw"))
    each = each.select("path", (F.col("line") + 1).alias("line"), F.try_validate_utf8(F.encode("raw", "ISO-8859-1").cast("string")).alias("text"))
    bad = each.groupBy("path").agg(F.min(F.when(F.col("text").isNull(), F.col("line"))).alias("bad"))
    return each.join(bad, "path").where("bad IS NULL OR line < bad").select("path", "line", "text")


def listing(files: DataFrame, folder: str) -> DataFrame:
    """Entries of a folder by name: subfolders end in /, files have a token count.  With a column link, linked files point to their target."""
    prefix = f"{folder}/" if folder else ""
    link = F.col("link") if "link" in files.columns else F.lit(None).cast("string")
    below = files.where(F.startswith("path", F.lit(prefix))).select(F.expr(f"substring(path, {len(prefix) + 1})").alias("rest"), "length", link.alias("link"))
    name = F.substring_index("rest", "/", 1)
    is_dir = F.contains("rest", F.lit("/"))
    own = F.when(F.col("link").isNotNull(), F.concat(name, F.lit(" -> "), "link")).otherwise(name)
    rows = below.select(F.when(is_dir, F.concat(name, F.lit("/"))).otherwise(own).alias("entry"), F.when(~is_dir, F.floor((F.col("length") + 3) / 4)).alias("tokens"))
    return rows.groupBy("entry").agg(F.max("tokens").alias("tokens")).orderBy("entry")
