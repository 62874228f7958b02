"""The supplied tables seen as a tree of files, their lines, and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = """CASE doc_id % 6 WHEN 0 THEN concat('src/', source, '/mod_', doc_id, '.rs') WHEN 1 THEN concat('docs/', source, '/', doc_id, '.md')
  WHEN 2 THEN concat('lib/', source, '/tests/', doc_id, '.test.js') WHEN 3 THEN concat('vendor/', source, '/', doc_id, '.go')
  WHEN 4 THEN concat('examples/', source, '/', doc_id, '.py') ELSE concat(source, '/', lang, '/', doc_id, '.txt') END"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, lang, source: every document as a file of a made-up tree."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text", "lang", "source")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text."""
    return L.lines(files(spark, sf_dir))


#: The same for DuckDB: common table expressions files and lines.
FILES_SQL = f"files AS (SELECT doc_id, {PATH} AS path, text, lang, source FROM documents)"
LINES_SQL = FILES_SQL + r""",
lines AS (SELECT path, (generate_subscripts(p, 1))::BIGINT AS line, regexp_replace(unnest(p), '\r$', '') AS text
  FROM (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM files WHERE length(text) > 0))"""
