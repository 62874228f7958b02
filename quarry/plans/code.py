"""Queries over source files that are written from the documents table, so that SQL can state the facts that must be found.

Every document gives a small Python, Rust or JavaScript file; comments and strings hold names that are no facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts
from ..functions import text as T
from ..operators import diff, lines
from ..operators.code import CodeBase
from . import corpus as C


def _source(*rows: str) -> str:
    """An SQL expression for a text of lines in which {i}, {n} and {c} stand for doc_id, the next of its kind, and a callee."""
    values = {"i": "doc_id", "n": "doc_id + 3", "c": "doc_id % 7"}
    parts = []
    for row in rows:
        pieces = row.replace("{", "\0{").replace("}", "}\0").split("\0")
        parts += [f"CAST({values[p[1:-1]]} AS VARCHAR(20))" if p.startswith("{") and p[1:-1] in values else "'" + p.replace("'", "''") + "'" for p in pieces if p]
        parts.append("chr(10)")
    return f"concat({', '.join(parts)})"


PYTHON = _source("from .m{n} import f{n}", "", "class C{i}:", "    def run(self, x):", "        return self.stop(f{c}(x))", "", "    def stop(self, x):", "        return x", "", "def f{i}(x):", "    # g{i}() is only in a comment", '    return C{i}().run("h{i}()")')
RUST = _source("use crate::m{n}::f;", "pub struct S{i} { x: i32 }", "impl S{i} {", "    pub fn get(&self) -> i32 {", "        f{c}(self.x)", "    }", "}", "", "pub fn f{i}(x: i32) -> i32 { // g{i}()", "    S{i}::get(x)", "}")
SCRIPT = _source('import { a } from "./m{n}";', "export class K{i} {", "  go(x) {", "    return f{c}(x);", "  }", "}", "export function f{i}(x) {", "  return new K{i}().go(x);", "}")
PATH = "CASE doc_id % 3 WHEN 0 THEN concat('src/m', doc_id, '.py') WHEN 1 THEN concat('src/m', doc_id, '.rs') ELSE concat('web/m', doc_id, '.js') END"
TEXT = f"CASE doc_id % 3 WHEN 0 THEN {PYTHON} WHEN 1 THEN {RUST} ELSE {SCRIPT} END"
FILES_SQL = f"files AS (SELECT doc_id AS i, {PATH} AS path, {TEXT.replace('VARCHAR(20)', 'VARCHAR')} AS text FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TEXT.replace("VARCHAR(20)", "STRING")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), F.expr(text).alias("text"))


def _base(spark: SparkSession, sf_dir: str) -> CodeBase:
    return CodeBase(files(spark, sf_dir).select("path", "text"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.symbols(files(spark, sf_dir)).select("path", "kind", "name", "depth", "start_line", "end_line", "signature")


SYMBOLS_SQL = f"""WITH {FILES_SQL}, s AS (
  SELECT i, path, unnest(CASE i % 3
    WHEN 0 THEN [{{'kind': 'class', 'name': concat('C', i), 'depth': 0, 'a': 3, 'b': 8, 's': concat('class C', i)}}, {{'kind': 'function', 'name': 'run', 'depth': 1, 'a': 4, 'b': 5, 's': 'def run(self, x)'}},
      {{'kind': 'function', 'name': 'stop', 'depth': 1, 'a': 7, 'b': 8, 's': 'def stop(self, x)'}}, {{'kind': 'function', 'name': concat('f', i), 'depth': 0, 'a': 10, 'b': 12, 's': concat('def f', i, '(x)')}}]
    WHEN 1 THEN [{{'kind': 'struct', 'name': concat('S', i), 'depth': 0, 'a': 2, 'b': 2, 's': concat('pub struct S', i)}}, {{'kind': 'module', 'name': concat('impl S', i), 'depth': 0, 'a': 3, 'b': 7, 's': concat('impl S', i)}},
      {{'kind': 'function', 'name': 'get', 'depth': 1, 'a': 4, 'b': 6, 's': 'pub fn get(&self) -> i32'}}, {{'kind': 'function', 'name': concat('f', i), 'depth': 0, 'a': 9, 'b': 11, 's': concat('pub fn f', i, '(x: i32) -> i32')}}]
    ELSE [{{'kind': 'class', 'name': concat('K', i), 'depth': 0, 'a': 2, 'b': 6, 's': concat('export class K', i)}}, {{'kind': 'function', 'name': 'go', 'depth': 1, 'a': 3, 'b': 5, 's': 'go(x)'}},
      {{'kind': 'function', 'name': concat('f', i), 'depth': 0, 'a': 7, 'b': 9, 's': concat('export function f', i, '(x)')}}] END) AS x FROM files)"""
CODE_SYMBOLS = f"{SYMBOLS_SQL} SELECT path, x.kind AS kind, x.name AS name, x.depth::BIGINT AS depth, x.a::BIGINT AS start_line, x.b::BIGINT AS end_line, x.s AS signature FROM s"


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.definitions(files(spark, sf_dir)).select("path", "line", "def_name", "def_weight", "impl_target")


CODE_DEFINITIONS = f"""{SYMBOLS_SQL} SELECT path, x.a::BIGINT AS line, CASE WHEN x.kind = 'module' THEN concat('S', i) ELSE x.name END AS def_name, CASE WHEN x.kind = 'module' THEN 90 ELSE 100 END::BIGINT AS def_weight,
  CASE WHEN x.kind = 'module' THEN concat('S', i) END AS impl_target FROM s"""


def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.calls(files(spark, sf_dir)).select("path", "line", "callee", "caller", "caller_start", "caller_end")


CALLS_SQL = f"""WITH {FILES_SQL}, c AS (
  SELECT i, path, unnest(CASE i % 3
    WHEN 0 THEN [{{'l': 5, 'e': 'stop', 'r': concat('C', i, '.run'), 'a': 4, 'b': 5}}, {{'l': 5, 'e': concat('f', i % 7), 'r': concat('C', i, '.run'), 'a': 4, 'b': 5}},
      {{'l': 12, 'e': concat('C', i), 'r': concat('f', i), 'a': 10, 'b': 12}}, {{'l': 12, 'e': 'run', 'r': concat('f', i), 'a': 10, 'b': 12}}]
    WHEN 1 THEN [{{'l': 5, 'e': concat('f', i % 7), 'r': 'get', 'a': 4, 'b': 6}}, {{'l': 10, 'e': 'get', 'r': concat('f', i), 'a': 9, 'b': 11}}]
    ELSE [{{'l': 4, 'e': concat('f', i % 7), 'r': concat('K', i, '.go'), 'a': 3, 'b': 5}}, {{'l': 8, 'e': concat('K', i), 'r': concat('f', i), 'a': 7, 'b': 9}}, {{'l': 8, 'e': 'go', 'r': concat('f', i), 'a': 7, 'b': 9}}] END) AS x FROM files)"""
CODE_CALLS = f"{CALLS_SQL} SELECT path, x.l::BIGINT AS line, x.e AS callee, x.r AS caller, x.a::BIGINT AS caller_start, x.b::BIGINT AS caller_end FROM c"


def code_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of two functions in one scan, and callers of those if they are few."""
    return _base(spark, sf_dir).callers(["f2", "K5"]).select("hop", "path", "line", "callee", "caller")


CODE_CALLERS = f"""{CALLS_SQL}, f AS (SELECT path, x.l AS line, x.e AS callee, x.r AS caller FROM c WHERE x.e IN ('f2', 'K5')), n AS (SELECT DISTINCT caller FROM f),
h AS (SELECT path, x.l AS line, x.e AS callee, x.r AS caller, row_number() OVER (PARTITION BY x.r, path ORDER BY x.l, x.e) AS k FROM c
  WHERE x.e IN (SELECT caller FROM n) AND (SELECT count(*) FROM n) <= 10 AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = c.path AND f.line = c.x.l))
SELECT 1::BIGINT AS hop, path, line::BIGINT AS line, callee, caller FROM f UNION ALL SELECT 2, path, line, callee, caller FROM h WHERE k = 1"""


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports joined to the files that they mean."""
    return facts.resolved_imports(files(spark, sf_dir)).select("path", "line", "target")


CODE_IMPORTS = f"WITH {FILES_SQL} SELECT a.path, 1::BIGINT AS line, b.path AS target FROM files a JOIN files b ON b.i = a.i + 3"


def code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index, asked for names: those in comments and strings are in no file."""
    index = facts.identifier_index(files(spark, sf_dir))
    return index.where(F.col("name").rlike("^[fghKCS][0-9]+$")).groupBy("name").agg(F.count("*").alias("files"))


CODE_IDENTIFIERS = f"""WITH {FILES_SQL}, n AS (SELECT i, unnest([concat('f', i), concat('f', i % 7), concat(CASE i % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'S' ELSE 'K' END, i), CASE WHEN i % 3 = 0 THEN concat('f', i + 3) END]) AS name FROM files)
SELECT name, count(DISTINCT i) AS files FROM n WHERE name IS NOT NULL GROUP BY name"""


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every definition and usage of a name, ranked."""
    return _base(spark, sf_dir).symbol("f5", n=None).select("path", "line", "is_definition", "stratum", "score")


SYMBOL_SEARCH = f"""WITH {FILES_SQL}, d AS (SELECT i, path, CASE i % 3 WHEN 0 THEN 10 WHEN 1 THEN 9 ELSE 7 END AS line FROM files WHERE i = 5),
u AS (SELECT i, path, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 5 ELSE 4 END AS line FROM files WHERE i % 7 = 5 UNION SELECT i, path, 1 FROM files WHERE i = 2 AND i % 3 = 0)
SELECT path, line::BIGINT AS line, true AS is_definition, 0::BIGINT AS stratum, (1000 + 220 + 160 + CASE i % 3 WHEN 2 THEN 70 + 75 WHEN 1 THEN 70 + 60 ELSE 0 END)::BIGINT AS score FROM d
UNION ALL SELECT path, line::BIGINT, false, 2::BIGINT, 160::BIGINT FROM u"""


def code_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse dependencies of one file: who calls what it defines."""
    return _base(spark, sf_dir).deps("src/m3.py", ("used_by",))["used_by"].select("path", "caller", "line", F.array_join("symbols", ",").alias("symbols"))


CODE_DEPENDENCIES = f"""{CALLS_SQL} SELECT path, x.r AS caller, min(x.l)::BIGINT AS line, array_to_string(list_sort(list(DISTINCT x.e)), ',') AS symbols
FROM c WHERE x.e IN ('C3', 'run', 'stop', 'f3') AND path <> 'src/m3.py' AND EXISTS (SELECT 1 FROM files WHERE path = 'src/m3.py') GROUP BY path, x.r"""


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of directories, and files with theirs and their top-level symbols."""
    return _base(spark, sf_dir).map().select("path", "tokens", F.array_join("symbols", ",").alias("symbols"))


CODE_MAP = f"""{SYMBOLS_SQL}, t AS (SELECT i, path, regexp_extract(path, '^[a-z]+') AS dir, (octet_length(encode(text)) + 3) // 4 AS tokens FROM files),
n AS (SELECT i, string_agg(x.name, ',' ORDER BY x.a) AS symbols FROM s WHERE x.depth = 0 GROUP BY i)
SELECT concat(dir, '/') AS path, sum(tokens)::BIGINT AS tokens, NULL AS symbols FROM t GROUP BY dir UNION ALL SELECT '/', sum(tokens)::BIGINT, NULL FROM t HAVING count(*) > 0
UNION ALL SELECT path, tokens::BIGINT, symbols FROM t JOIN n USING (i)"""


def code_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a function calls, and what those call, each once."""
    return _base(spark, sf_dir).callees_two_hops("src/m3.py", "f3").select("hop", "via", "name", "path", "start_line")


CODE_TWO_HOPS = f"""WITH {FILES_SQL}, c AS (SELECT unnest([{{'h': 1, 'v': 'f3', 'n': 'C3', 'a': 3}}, {{'h': 1, 'v': 'f3', 'n': 'run', 'a': 4}}, {{'h': 2, 'v': 'C3', 'n': 'stop', 'a': 7}}]) AS x FROM files WHERE i = 3)
SELECT x.h::BIGINT AS hop, x.v AS via, x.n AS name, 'src/m3.py' AS path, x.a::BIGINT AS start_line FROM c"""


def code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ranges of files as one answer."""
    return _base(spark, sf_dir).read_sections([("src/m3.py", 10, 12), ("src/m1.rs", 1, 2), ("src/none.py", 1, 9)]).select("nth", "path", "text", "shown")


CODE_SECTIONS = f"""WITH {FILES_SQL}, l AS (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM files), w AS (SELECT * FROM (VALUES (0, 'src/m3.py', 10, 12), (1, 'src/m1.rs', 1, 2), (2, 'src/none.py', 1, 9)) v(n, path, a, b))
SELECT n::BIGINT AS nth, w.path, coalesce(array_to_string(p[a:b], chr(10)), '') AS text, true AS shown FROM w LEFT JOIN l ON w.path = l.path"""


def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files against a state in which some functions have other names, bodies or signatures, and some files are gone."""
    old = files(spark, sf_dir)
    i = F.col("doc_id")
    f = F.concat(F.lit("f"), i.cast("string"), F.lit("(x"))
    new = old.where("doc_id % 10 <> 9").withColumn("text", F.when(i % 10 == 1, F.replace("text", f, F.concat(F.lit("q"), i.cast("string"), F.lit("(x")))).when((i % 10 == 3) & (i % 3 == 0), F.replace("text", F.lit("return x\n"), F.lit("return x + 1\n"))).otherwise(F.col("text")))
    changes = CodeBase(new.select("path", "text")).changed_since(CodeBase(old.select("path", "text")))
    return changes.groupBy("change").agg(F.count("*").alias("n"))


STRUCTURAL_DIFF = f"""WITH {FILES_SQL}, o AS (SELECT * FROM files),
c AS (SELECT 'renamed' AS change, count(*) AS n FROM o WHERE i % 10 = 1 UNION ALL SELECT 'body_changed', 2 * count(*) FROM o WHERE i % 10 = 3 AND i % 3 = 0
  UNION ALL SELECT 'deleted', sum(CASE i % 3 WHEN 2 THEN 3 ELSE 4 END)::BIGINT FROM o WHERE i % 10 = 9)
SELECT change, n FROM c WHERE n > 0"""


def edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by line and hash: those with a stale hash leave their file alone; the edited texts as digests."""
    base = _base(spark, sf_dir)
    first = lines.lines(files(spark, sf_dir).select("path", "text", "doc_id"), ["path", "doc_id"]).where("line = 2")
    stale = F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0)
    edits = first.select("path", F.col("line").alias("start"), (F.col("line") + 1).alias("end"), ((T.fnv12(F.col("text")) + stale) % 4096).alias("start_hash"), F.lit("# edited\n# twice\n# thrice").alias("content"))
    return base.apply(edits).select("path", F.sha2("text", 256).alias("digest"))


EDIT_BATCH = rf"""WITH {FILES_SQL}, l AS (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM files WHERE i % 8 <> 0)
SELECT path, sha256(array_to_string(list_concat(p[1:1], ['# edited', '# twice', '# thrice'], p[4:]), chr(10))) AS digest FROM l"""


def unified_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each document, parsed: insertions, deletions and new line numbers."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("diff --git a/x"), i, F.lit(" b/x"), i, F.lit("\n--- a/x\n+++ b/x\n@@ -"), (F.col("doc_id") + 1).cast("string"), F.lit(",2 +"), (F.col("doc_id") + 5).cast("string"), F.lit(",3 @@\n keep\n-old\n+new "), i, F.lit("\n+more\n"))
    rows = diff.diff_lines(C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patch_id"), text.alias("text")))
    return rows.groupBy("patch_id", "path").agg(F.count_if(F.col("kind") == "added").alias("insertions"), F.count_if(F.col("kind") == "removed").alias("deletions"), F.max("new_line").alias("last_new"), F.max("old_line").alias("last_old"))


UNIFIED_DIFF_LINES = "SELECT doc_id AS patch_id, concat('x', doc_id) AS path, 2::BIGINT AS insertions, 1::BIGINT AS deletions, doc_id + 7 AS last_new, doc_id + 2 AS last_old FROM documents"

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (code_symbols, CODE_SYMBOLS), (code_definitions, CODE_DEFINITIONS), (code_calls, CODE_CALLS), (code_callers, CODE_CALLERS), (code_imports, CODE_IMPORTS), (code_identifiers, CODE_IDENTIFIERS),
        (symbol_search, SYMBOL_SEARCH), (code_dependencies, CODE_DEPENDENCIES), (code_map, CODE_MAP), (code_two_hops, CODE_TWO_HOPS), (code_sections, CODE_SECTIONS), (structural_diff, STRUCTURAL_DIFF), (edit_batch, EDIT_BATCH), (unified_diff_lines, UNIFIED_DIFF_LINES),
    )
}
