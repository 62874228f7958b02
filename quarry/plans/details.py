"""Queries over views, rules, spans, manifests, changes and reports, with their SQL; files that SQL must foresee are written from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, rules
from ..functions import text as T
from ..operators import diff, graph, lines, pack, rollup, search, stats
from ..operators.code import CodeBase
from ..sources import codefs, documents
from . import code, relations
from . import corpus as C
from .blocks import TOKENS


def _base(spark: SparkSession, sf_dir: str) -> CodeBase:
    return CodeBase(code.files(spark, sf_dir).select("path", "text"))


# --- rules ---

#: Names of files, their media type, preference among files of one stem, whether tools write them, whether they are minified.
NAMES = (
    ("Cargo.lock", "application/octet-stream", 3, True, False), ("logo.PNG", "image/png", 3, False, False), ("main.ts", "application/octet-stream", 10, False, False),
    ("lib.rs", "application/octet-stream", 9, False, False), ("tool.mjs", "application/octet-stream", 7, False, False), ("app.min.js", "application/octet-stream", 7, False, True),
    ("app-min.css", "application/octet-stream", 3, False, True), ("go.sum", "application/octet-stream", 3, True, False), ("x.tar", "application/x-tar", 3, False, False), ("README", "application/octet-stream", 3, False, False),
)


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name of a file and its first bytes say, for a file for each document."""
    name = F.element_at(F.array(*(F.lit(n[0]) for n in NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit("/"), name).alias("path"))
    i = F.col("doc_id") % 3
    content = F.when(i == 0, F.concat(F.encode(F.lit("ab"), "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode(F.lit("ab"), "UTF-8"))
    text = F.when(i == 1, F.concat(F.lit("// Code made by x. DO NOT EDIT\n"), F.col("path"))).otherwise(F.lit("edit"))
    return d.select(
        "path", rules.mime(F.col("path")).alias("mime"), rules.source_priority(F.col("path")).alias("priority"), (rules.is_generated_name(F.col("path")) | rules.is_generated_text(text)).alias("generated"),
        rules.is_minified_name(F.col("path")).alias("minified"), rules.is_binary(content).alias("is_binary"),
    )


NAME_RULES = f"""WITH n AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', '{m}', {p}, {g}, {s})" for k, (n, m, p, g, s) in enumerate(NAMES))}) v(k, name, mime, priority, generated, minified))
SELECT concat('d', doc_id, '/', name) AS path, mime, priority::BIGINT AS priority, generated OR doc_id % 3 = 1 AS generated, minified, doc_id % 3 = 0 AS is_binary FROM documents JOIN n ON doc_id % {len(NAMES)} = k"""


def whole_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a name between characters that belong to no ASCII name."""
    return C.lines(spark, sf_dir).where(T.whole_identifier(F.col("text"), "the")).select("path", "line")


WHOLE_IDENTIFIERS = f"WITH {C.LINES_SQL} SELECT path, line FROM lines WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')"


def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin like a definition and hold a part of its name."""
    return lines.lines(code.files(spark, sf_dir)).where(rules.is_definition_line(F.col("text"), "f1")).select("path", "line")


DEFINITION_LINES = f"""WITH {code.FILES_SQL} SELECT path, CASE i % 3 WHEN 0 THEN 10 WHEN 1 THEN 9 ELSE 7 END::BIGINT AS line FROM files WHERE starts_with(i::VARCHAR, '1')"""


def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of files, anchors read back, short kinds, and labels of changes."""
    kinds, changes = F.array(*map(F.lit, ("function", "interface", "constant", "module"))), F.array(*map(F.lit, ("renamed", "signature_changed", "moved")))
    of = lambda a, n: F.element_at(a, (F.col("doc_id") % n + 1).cast("int"))
    anchor = F.when(F.col("doc_id") % 5 == 0, F.lit("7:xyz")).otherwise(T.anchor_of(F.col("doc_id"), F.col("doc_id") % 4096))
    d = C.table(spark, sf_dir, "documents").withColumn("a", T.anchor_parts(anchor))
    head = T.header(F.concat(F.lit("d/"), "doc_id"), F.octet_length("text"), F.col("doc_id"), F.lit("full"))
    mark = diff.marker(of(changes, 3), F.when(F.col("doc_id") % 7 == 0, "ambiguous").otherwise("exact"))
    return d.select("doc_id", head.alias("header"), "a.line", "a.hash", rules.short_kind(of(kinds, 4)).alias("kind"), mark.alias("mark"), diff.change_label(of(changes, 3)).alias("label"))


LABEL_FORMS = f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT doc_id, concat('# d/', doc_id, ' (', doc_id, ' lines, ', CASE WHEN t < 1000 THEN concat('~', t) ELSE concat('~', t // 1000, '.', t % 1000 // 100, 'k') END, ' tokens) [full]') AS header,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS line, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4096 END AS hash, ['fn', 'trait', 'const', ''][doc_id % 4 + 1] AS kind,
  CASE WHEN doc_id % 7 = 0 THEN '[?→]' ELSE ['[→]', '[~:sig]', '[↦]'][doc_id % 3 + 1] END AS mark, ['renamed', 'signature changed', 'moved'][doc_id % 3 + 1] AS label FROM d"""


# --- lines and views ---


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two folders: files with their tokens, folders with a slash."""
    own = code.files(spark, sf_dir).select("path", F.octet_length("text").alias("length"))
    return codefs.listing(own, "src").union(codefs.listing(own, ""))


FOLDER_LISTING = f"""WITH {code.FILES_SQL} SELECT substr(path, 5) AS entry, {TOKENS} AS tokens FROM files WHERE starts_with(path, 'src/')
UNION ALL SELECT DISTINCT concat(regexp_extract(path, '^[a-z]+'), '/'), NULL::BIGINT FROM files"""


def expanded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to show for matches: whole files of few tokens, some lines around the match in others."""
    rows = C.lines(spark, sf_dir)
    hits = rows.where(F.contains("text", F.lit("thand"))).select("path", "line", F.lit(None).cast("int").alias("def_start"), F.lit(None).cast("int").alias("def_end"))
    return lines.expanded(rows, hits, 2, 100).select("path", "match", "line")


EXPANDED_LINES = rf"""WITH {C.LINES_SQL}, s AS (SELECT path, sum(octet_length(encode(text)) + 1) AS n FROM lines GROUP BY path), m AS (SELECT path, line AS match, n FROM lines JOIN s USING (path) WHERE contains(text, 'thand'))
SELECT path, match, line FROM m JOIN lines USING (path) WHERE (n < 400 OR line BETWEEN match - 2 AND match + 2) AND NOT (match - 2 <= 5 AND line < match AND regexp_matches(text, '^\s*(import |from |use |#include|require )'))"""


def fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced blocks of a Markdown file for each document; the last may be open."""
    text = F.concat(F.lit("# T\n"), F.expr("repeat('```\nx\n', doc_id % 5 + 1)"), F.lit("a ``` b\n"))
    files = C.table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), text.alias("text"))
    return lines.code_blocks(lines.lines(files), ["path"])


FENCED_BLOCKS = "SELECT concat(doc_id, '.md') AS path, (doc_id % 5 + 2) // 2 AS blocks FROM documents"


def table_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tables: header, five first and three last rows."""
    rows = C.lines(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".csv")))
    return documents.table_view(rows).select("path", "line", "part", "total")


TABLE_VIEWS = f"""WITH {C.LINES_SQL}, n AS (SELECT concat(path, '.csv') AS path, line, count(*) OVER (PARTITION BY path) AS total FROM lines)
SELECT path, line, CASE WHEN line <= 6 THEN 'head' ELSE 'tail' END AS part, total FROM n WHERE line <= 6 OR line > total - 3"""


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII characters of documents, every seventh word at a line's start, cut to 100 tokens; and the first of three texts that fits 400 tokens."""
    plain = F.regexp_replace(F.regexp_replace("text", "[^ -~]+", " "), "((?:[^ ]+ ){7})", "$1\n")
    text = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, F.replace(plain, F.lit("\n"), F.lit("\n\n"))).otherwise(F.replace(plain, F.lit("\n"), F.lit("\n\n## ")))
    d = C.table(spark, sf_dir, "documents").withColumn("t", text)
    level = pack.degraded([F.col("t"), F.substring("t", 1, 1200), F.lit("none")], 200)
    return d.select("doc_id", F.sha2(pack.cut(F.col("t"), 100), 256).alias("cut"), F.sha2(pack.degraded([F.col("t"), F.substring("t", 1, 1200), F.lit("none")], 400), 256).alias("wide"), F.sha2(level, 256).alias("narrow"))


CUT_TEXTS = r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^ -~]+', ' ', 'g'), '(([^ ]+ ){7})', '\1' || chr(10), 'g') AS t FROM documents),
d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN replace(t, chr(10), chr(10) || chr(10)) ELSE replace(t, chr(10), chr(10) || chr(10) || '## ') END AS t FROM p),
h AS (SELECT doc_id, t, left(t, 200) AS h, reverse(left(t, 200)) AS r FROM d), e AS (SELECT *, position(' ##' || chr(10) || chr(10) IN r) AS a, position(chr(10) || chr(10) IN r) AS b, position(chr(10) IN r) AS c FROM h)
SELECT doc_id, sha256(CASE WHEN length(t) <= 400 THEN t ELSE left(h, CASE WHEN a > 0 THEN length(h) - a - 4 WHEN b > 0 THEN length(h) - b - 1 WHEN c > 0 THEN length(h) - c ELSE length(h) END) || chr(10) || chr(10) || '... truncated' END) AS cut,
  sha256(CASE WHEN length(t) <= 1600 THEN t ELSE left(t, 1200) END) AS wide, sha256(CASE WHEN length(t) <= 800 THEN t ELSE 'none' END) AS narrow FROM e"""


# --- spans and edges ---


def conflict_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of a file for each document, with the innermost and the outermost definition that holds their start."""
    i = F.col("doc_id") % 9
    text = F.concat(F.expr("repeat('x\n', CAST(doc_id % 9 AS INT))"), F.lit("<<<<<<< a\nours\n=======\ntheirs\n>>>>>>> b\nrest\n"), F.when(i > 4, "<<<<<<< open\n").otherwise(""))
    d = C.table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".py")).alias("path"), text.alias("text"))
    found = diff.conflicts(lines.lines(d), ["path"])
    spans = d.select("path", F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("name")) for a, b, n in ((1, 3, "f"), (2, 6, "g"), (2, 5, "h"))))).alias("s")).select("path", "s.*")
    points = found.select("path", F.col("start").alias("at"), "middle", F.col("end").alias("last"))
    inner = graph.innermost(points, spans, "path", "at", ["name"])
    return inner.join(graph.first_enclosing(points, spans, "path", "at", ["name"]).select("path", F.col("name").alias("outer")), "path")


CONFLICT_FUNCTIONS = """SELECT concat(doc_id, '.py') AS path, doc_id % 9 + 1 AS at, doc_id % 9 + 3 AS middle, doc_id % 9 + 5 AS last, CASE WHEN doc_id % 9 = 0 THEN 'f' WHEN doc_id % 9 < 5 THEN 'h' WHEN doc_id % 9 = 5 THEN 'g' END AS name,
  CASE WHEN doc_id % 9 < 3 THEN 'f' WHEN doc_id % 9 < 6 THEN 'g' END AS "outer" FROM documents"""


def overlapping_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of their user's file, whose first lines a click touches."""
    e = C.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("start"), (F.col("event_id") + F.col("event_id") % 5).alias("end"))
    return graph.overlapping(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id").select("user_id", "start", "end")


OVERLAPPING_EDITS = """SELECT user_id, event_id AS start, event_id + event_id % 5 AS "end" FROM events s WHERE event_type <> 'click'
  AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'click' AND r.user_id = s.user_id AND s.event_id <= r.event_id + r.event_id % 5 AND r.event_id <= least(s.event_id + 3, s.event_id + s.event_id % 5))"""


def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many callers and sites some names have, and how many callers of those."""
    names = C.table(spark, sf_dir, "customer").where("c_custkey IN (1, 2, 4, 5, 7, 8)").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.impact_totals(graph.impact(relations._calls(spark, sf_dir), names))


IMPACT_TOTALS = f"""WITH {relations.CALLS_SQL}, f AS (SELECT * FROM calls WHERE callee IN ('c1', 'c2', 'c4', 'c5', 'c7', 'c8')), n AS (SELECT DISTINCT caller FROM f),
h AS (SELECT * FROM calls c WHERE callee IN (SELECT caller FROM n) AND (SELECT count(*) FROM n) <= 10 AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = c.path AND f.line = c.line))
SELECT (SELECT count(DISTINCT caller) FROM f) AS callers, (SELECT count(*) FROM f) AS sites, (SELECT count(*) FROM (SELECT DISTINCT caller, path FROM h)) AS indirect"""


def ranked_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 call sites of a name: those of the file at hand, then by depth, path and line."""
    sites = graph.callers(relations._calls(spark, sf_dir), C.table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("name")))
    return graph.ranked_callers(sites, "3-MEDIUM").limit(20).select("path", "line", "caller")


RANKED_CALLERS = f"""WITH {relations.CALLS_SQL} SELECT path, line, caller FROM calls WHERE callee IN (SELECT concat('p', c_custkey % 3) FROM customer) ORDER BY path <> '3-MEDIUM', path, line LIMIT 20"""


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names nearest to one that isn't there."""
    return search.did_you_mean(C.table(spark, sf_dir, "customer").select("c_name"), "c_name", "Customer#00000O12", 3, 30)


NEAR_NAMES = "SELECT c_name, levenshtein(c_name, 'Customer#00000O12') AS distance FROM customer WHERE levenshtein(c_name, 'Customer#00000O12') <= 3 ORDER BY distance, c_name LIMIT 30"


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules without the directory that all share, and without those that hold no source."""
    part = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "tests/").otherwise(F.concat("source", F.lit("/")))
    files = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("code/"), part, "doc_id", F.lit(".py")).alias("path"), F.lit("python").alias("lang"))
    return rollup.module_names(files)


MODULE_NAMES = "SELECT source AS name, count(*) AS files FROM documents WHERE doc_id % 4 > 1 AND source IS NOT NULL GROUP BY source HAVING count(*) > 1 ORDER BY files DESC, name LIMIT 10"


# --- files of facts ---


def code_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.members(code.files(spark, sf_dir))


CODE_MEMBERS = f"WITH {code.FILES_SQL} SELECT path, 5::BIGINT AS line, CASE i % 3 WHEN 0 THEN 'stop' ELSE 'x' END AS name FROM files WHERE i % 3 < 2"

_SUITE = code._source("describe('s{i}', () => {", '  it("a{i}", () => { x(); });', "  context('c', () => {", "    test.skip('b', f);", "  });", "});", "test(`z{i}`, f);", "// it('none', f)")


def test_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites and tests of a file for each document."""
    text = F.expr(_SUITE.replace("VARCHAR(20)", "STRING").replace("\\", "\\\\"))
    return facts.tests(C.table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".test.js")).alias("path"), text.alias("text")))


TEST_SUITES = """SELECT concat(i, '.test.js') AS path, x.l::BIGINT AS line, x.d::BIGINT AS depth, x.k AS kind, x.n AS name FROM (SELECT doc_id AS i, unnest([{'l': 1, 'd': 0, 'k': 'suite', 'n': concat('s', doc_id)}, {'l': 2, 'd': 1, 'k': 'test', 'n': concat('a', doc_id)},
  {'l': 3, 'd': 1, 'k': 'suite', 'n': 'c'}, {'l': 4, 'd': 2, 'k': 'test', 'n': 'b'}, {'l': 7, 'd': 0, 'k': 'test', 'n': concat('z', doc_id)}]) AS x FROM documents)"""


def edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not parse after an edit, beyond what did not before."""
    old = code.files(spark, sf_dir).where("doc_id % 3 > 0").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, ")\n").otherwise("")))
    new = old.withColumn("text", F.concat(F.lit("// ) in a comment\n"), "text", F.when(F.col("doc_id") % 5 == 0, ")\n").when(F.col("doc_id") % 5 == 1, "{\n").otherwise("")))
    return diff.new_errors(facts.errors(old), facts.errors(new), ["path", "kind", "detail"])


EDIT_ERRORS = f"""WITH {code.FILES_SQL} SELECT path, CASE i % 5 WHEN 0 THEN 'error' ELSE 'missing' END AS kind, CASE i % 5 WHEN 0 THEN ')' ELSE '}}' END AS detail, (CASE i % 3 WHEN 1 THEN 11 ELSE 9 END + 1 + (i % 2 = 0)::INT + 1)::BIGINT AS line
FROM files WHERE i % 3 > 0 AND i % 5 < 2"""


def project_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each document, some of them broken."""
    cargo = code._source("[package]", 'name = "c{i}"', 'version = "1.{i}"', "[dependencies]", 'serde = "1"', 'anyhow = "{i}"')
    node = code._source('{"name": "n{i}", "version": "2.{i}", "dependencies": {"b": "1", "a{i}": "2"}}')
    poetry = code._source("[project]", 'name = "p{i}"', 'dependencies = ["numpy>=1.{i}", "attrs"]')
    go = code._source("module example.com/m{i}", "", "require (", "\tgithub.com/z/y v1.0.{i}", "\tgithub.com/a/b v1.0.0", ")")
    text = "CASE doc_id % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE '[package' END".format(*(s.replace("VARCHAR(20)", "STRING") for s in (cargo, node, poetry, go)))
    name = F.element_at(F.array(*map(F.lit, ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "Cargo.toml"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id", F.lit("/"), name).alias("path"), F.expr(text).alias("text"))
    return documents.manifests(files).withColumn("dependencies", F.array_join("dependencies", ","))


PROJECT_MANIFESTS = """SELECT concat('p', doc_id, '/', ['Cargo.toml', 'package.json', 'pyproject.toml', 'go.mod', 'Cargo.toml'][doc_id % 5 + 1]) AS path,
  CASE doc_id % 5 WHEN 0 THEN concat('c', doc_id) WHEN 1 THEN concat('n', doc_id) WHEN 2 THEN concat('p', doc_id) WHEN 3 THEN concat('example.com/m', doc_id) END AS name, CASE doc_id % 5 WHEN 0 THEN concat('1.', doc_id) WHEN 1 THEN concat('2.', doc_id) END AS version,
  CASE doc_id % 5 WHEN 0 THEN 'anyhow,serde' WHEN 1 THEN concat('a', doc_id, ',b') WHEN 2 THEN 'attrs,numpy' WHEN 3 THEN 'github.com/a/b,github.com/z/y' ELSE '' END AS dependencies FROM documents"""


def structured_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON, a TOML or a YAML file for each document, with sizes and previews; long values are shortened."""
    js = code._source('{"a": [{i}, 2], "b": {"c": "x{i}", "d": null}, "e": true}')
    toml = code._source("a = {i}", "[b]", "c = 'x{i}'")
    yaml = code._source("a: {i}", "b:", "  c: x{i}", "    deep: 1", "# note")
    text = "CASE doc_id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*(s.replace("VARCHAR(20)", "STRING") for s in (js, toml, yaml)))
    ext = F.element_at(F.array(F.lit(".json"), F.lit(".toml"), F.lit(".yaml")), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents.outline(C.table(spark, sf_dir, "documents").select(F.concat("doc_id", ext).alias("path"), F.expr(text).alias("text")))


STRUCTURED_OUTLINES = """WITH o AS (SELECT doc_id AS i, concat(doc_id, ['.json', '.toml', '.yaml'][doc_id % 3 + 1]) AS path, doc_id::VARCHAR AS n, concat('x', doc_id) AS x FROM documents),
k AS (SELECT path, unnest(CASE i % 3
  WHEN 0 THEN [{'k': 'a', 't': 'array', 's': 2, 'p': concat('[', n, ', 2]')}, {'k': 'a.[0]', 't': 'number', 's': 1, 'p': n}, {'k': 'b', 't': 'object', 's': 2, 'p': left(concat('{"c": "', x, '", "d": null}'), 40)}, {'k': 'b.c', 't': 'string', 's': length(x), 'p': concat('"', x, '"')},
    {'k': 'b.d', 't': 'null', 's': 1, 'p': 'null'}, {'k': 'e', 't': 'boolean', 's': 1, 'p': 'true'}]
  WHEN 1 THEN [{'k': 'a', 't': 'number', 's': 1, 'p': n}, {'k': 'b', 't': 'object', 's': 1, 'p': concat('{"c": "', x, '"}')}, {'k': 'b.c', 't': 'string', 's': length(x), 'p': concat('"', x, '"')}]
  ELSE [{'k': 'a', 't': 'string', 's': length(n), 'p': n}, {'k': 'b', 't': 'object', 's': 0, 'p': ''}, {'k': 'b.c', 't': 'string', 's': length(x), 'p': x}] END) AS v FROM o)
SELECT path, v.k AS key, v.t AS kind, v.s::BIGINT AS size, v.p AS preview FROM k"""


# --- questions ---


def code_grok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition's bundle: where it is, what it calls, who calls it, what is beside it."""
    return _base(spark, sf_dir).grok("f3")


CODE_GROK = f"""WITH {code.FILES_SQL}, t AS (SELECT unnest([{{'p': 'target', 'l': 10, 'n': 'f3', 'd': 'def f3(x):'}}, {{'p': 'callees', 'l': 3, 'n': 'C3', 'd': 'class C3'}}, {{'p': 'callees', 'l': 4, 'n': 'run', 'd': 'def run(self, x)'}}, {{'p': 'siblings', 'l': 3, 'n': 'C3', 'd': 'class C3'}}]) AS x FROM files WHERE i = 3),
c AS (SELECT path, CASE i % 3 WHEN 2 THEN 4 ELSE 5 END::BIGINT AS line, CASE i % 3 WHEN 0 THEN concat('C', i, '.run') WHEN 1 THEN 'get' ELSE concat('K', i, '.go') END AS name, CASE i % 3 WHEN 0 THEN 'return self.stop(f3(x))' WHEN 1 THEN 'f3(self.x)' ELSE 'return f3(x);' END AS detail
  FROM files WHERE i % 7 = 3 AND EXISTS (SELECT 1 FROM t) ORDER BY path LIMIT 5)
SELECT x.p AS part, 'src/m3.py' AS path, x.l::BIGINT AS line, x.n AS name, x.d AS detail FROM t UNION ALL SELECT 'callers', path, line, name, detail FROM c"""


def code_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one file: outline, the definition at a line, members that a method uses, symbols beside one, a body, what is listed under a match."""
    base, path = _base(spark, sf_dir), "src/m3.py"
    name = lambda what, d, line="start_line": d.select(F.lit(what).alias("what"), F.col(line).cast("long").alias("line"), "name")
    body = base.body(path, "stop").select(F.lit("body").alias("what"), F.col("line").cast("long").alias("line"), F.col("text").alias("name"))
    out = name("outline", base.outline(path)).union(name("at", base.at(path, 8))).union(name("members", base.member_siblings(path, "run")))
    return out.union(name("peers", graph.peers(base.symbols, path, "run"))).union(name("footer", base.footer(path, "f3"))).union(body)


CODE_AROUND = f"""WITH {code.FILES_SQL} SELECT x.w AS what, x.l::BIGINT AS line, x.n AS name FROM (SELECT unnest([{{'w': 'outline', 'l': 3, 'n': 'C3'}}, {{'w': 'outline', 'l': 4, 'n': 'run'}}, {{'w': 'outline', 'l': 7, 'n': 'stop'}}, {{'w': 'outline', 'l': 10, 'n': 'f3'}},
  {{'w': 'at', 'l': 7, 'n': 'stop'}}, {{'w': 'members', 'l': 7, 'n': 'stop'}}, {{'w': 'peers', 'l': 7, 'n': 'stop'}}, {{'w': 'footer', 'l': 3, 'n': 'C3'}}, {{'w': 'footer', 'l': 4, 'n': 'run'}}, {{'w': 'footer', 'l': 7, 'n': 'stop'}},
  {{'w': 'body', 'l': 7, 'n': '    def stop(self, x):'}}, {{'w': 'body', 'l': 8, 'n': '        return x'}}]) AS x FROM files WHERE i = 3)"""


def code_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, modules, most imported files and test style of the tree."""
    found = _base(spark, sf_dir).fingerprint()
    rows = lambda what, d, name, n: d.select(F.lit(what).alias("what"), F.col(name).alias("name"), F.col(n).cast("long").alias("n"))
    style = found["tests"].select(F.explode(F.map_filter(F.create_map(*(x for c in found["tests"].columns for x in (F.lit(c), F.col(c)))), lambda _, v: v)).alias("name", "v"))
    out = rows("language", found["languages"], "lang", "n").union(rows("module", found["modules"], "name", "files")).union(rows("hot", found["hot"], "target", "importers"))
    return out.union(rows("style", style.withColumn("n", F.lit(1)), "name", "n"))


CODE_FINGERPRINT = f"""WITH {code.FILES_SQL}, l AS (SELECT CASE i % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'javascript' END AS lang, count(*) AS n FROM files GROUP BY 1), m AS (SELECT lang FROM l ORDER BY n DESC, lang LIMIT 1)
SELECT 'language' AS what, lang AS name, n FROM l UNION ALL SELECT 'module', CASE lang WHEN 'javascript' THEN 'web' ELSE 'src' END, n FROM m JOIN l USING (lang) WHERE n >= 2"""


# --- changes ---


def moved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files against a state in which some are in another folder and some methods take more; names whose signature changed more than once."""
    old = code.files(spark, sf_dir)
    to = F.when(F.col("doc_id") % 10 == 4, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 10 == 5, F.replace("text", F.lit("def run(self, x)"), F.lit("def run(self, x, y)"))).otherwise(F.col("text"))
    changes = CodeBase(old.select(to.alias("path"), text.alias("text"))).changed_since(CodeBase(old.select("path", "text")))
    warned = diff.signature_warnings(changes).select(F.lit("warning").alias("change"), "name", "n", F.lit(0).cast("long").alias("named"))
    return changes.groupBy("change", "name").agg(F.count("*").alias("n"), F.count("old_path").alias("named")).where("change <> 'signature_changed' AND change <> 'body_changed'").union(warned)


MOVED_SYMBOLS = f"""{code.SYMBOLS_SQL}, m AS (SELECT x.kind AS kind, x.name AS name, count(*) AS n FROM s WHERE i % 10 = 4 GROUP BY 1, 2)
SELECT 'moved' AS change, name, 2 * n AS n, 2 * n AS named FROM m WHERE n = 1 UNION ALL SELECT c, name, n, 0 FROM m, (VALUES ('deleted'), ('added')) v(c) WHERE n > 1
UNION ALL SELECT 'warning', 'run', count(*), 0 FROM files WHERE i % 10 = 5 AND i % 3 = 0 HAVING count(*) > 1"""


def diff_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff lines within symbols; of these the changes that hold a text, in files of a scope, with what the diff says of the file."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("diff --git a/x"), i, F.lit(" b/x"), i, F.lit("\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n keep\n-old "), i, F.lit("\n+New "), i, F.lit("\n+more\n"))
    d = C.table(spark, sf_dir, "documents")
    rows = diff.diff_lines(d.select(F.col("doc_id").alias("patch_id"), text.alias("text")))
    span = lambda name, a, b, change: F.struct(F.lit(name).alias("n"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(change).alias("change"))
    own = d.select(F.concat(F.lit("x"), i).alias("path"), i.alias("i"), F.explode(F.array(span("f", 1, 2, "body_changed"), span("g", 3, 9, "added"), span("new 2", 2, 2, "deleted"))).alias("s"))
    changes = own.select("path", F.concat("s.n", F.lit(" "), "i").alias("name"), F.lit("function").alias("kind"), "s.start_line", "s.end_line", "s.change")
    found = diff.attribute(rows, changes)
    held = diff.with_files(diff.holding(diff.in_scope(changes, "7"), diff.in_scope(found, "7"), "nEw 2"), rows).select("path", "name", F.lit("held").alias("line_kind"), "status")
    return found.select("path", "name", "line_kind", F.lit(None).cast("string").alias("status")).union(held)


DIFF_ATTRIBUTION = """WITH d AS (SELECT doc_id::VARCHAR AS i FROM documents), r AS (SELECT i, unnest([{'n': 'f', 'k': 'context'}, {'n': 'f', 'k': 'added'}, {'n': 'g', 'k': 'added'}, {'n': 'new 2', 'k': 'removed'}]) AS x FROM d)
SELECT concat('x', i) AS path, concat(x.n, ' ', i) AS name, x.k AS line_kind, NULL AS status FROM r
UNION ALL SELECT concat('x', i), concat(n, ' ', i), 'held', 'modified' FROM d, (VALUES ('f'), ('new 2')) v(n) WHERE ends_with(i, '7') AND (n = 'new 2' OR starts_with(i, '2'))"""


# --- reports ---


def tool_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as runs: calls by kind of tool, and for each turn; runs with an error are left out."""
    e = C.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    runs = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("tool_calls"), F.count("*").alias("turns"), F.max(F.when(F.col("m") % 6 == 0, "late")).alias("error"))
    out = stats.ratios(stats.valid_runs(runs), "turns", {"reads": ("view", "cli"), "writes": ("purchase",)}, "tool_calls")
    return out.select("user_id", "turns", "reads", "writes", F.round("reads_per_turn", 9).alias("reads_per_turn"), F.round("writes_per_turn", 9).alias("writes_per_turn"))


TOOL_RATIOS = """WITH t AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1, 2),
u AS (SELECT user_id, count(*) AS turns, coalesce(sum(n) FILTER (regexp_matches(event_type, 'view|cli')), 0)::BIGINT AS reads, coalesce(sum(n) FILTER (contains(event_type, 'purchase')), 0)::BIGINT AS writes FROM t GROUP BY user_id HAVING NOT bool_or(m % 6 = 0))
SELECT *, round(reads / turns, 9) AS reads_per_turn, round(writes / turns, 9) AS writes_per_turn FROM u"""


def version_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two versions by task: number, share that is right, medians and their change."""
    r = C.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("task"), F.when(F.col("o_orderkey") % 2 == 0, "new").otherwise("old").alias("version"), (F.col("o_orderstatus") == "F").alias("correct"), F.col("o_totalprice").cast("double").alias("cost"))
    return stats.version_report(r, ["task"], "version", "old", "new", "correct", "cost")


VERSION_REPORT = """WITH s AS (SELECT o_custkey % 50 AS task, o_orderkey % 2 = 0 AS v, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS a, median(o_totalprice::DOUBLE) AS m FROM orders GROUP BY 1, 2)
SELECT o.task, o.n AS old_runs, n.n AS new_runs, round(o.a, 6) AS old_accuracy, round(n.a, 6) AS new_accuracy, round(o.m, 6) AS old_median, round(n.m, 6) AS new_median, round(CASE WHEN o.m = 0 THEN 0.0 ELSE (n.m - o.m) * 100.0::DOUBLE / o.m END, 6) AS delta_percent,
  CASE WHEN n.a > o.a THEN 'better' WHEN n.a < o.a THEN 'worse' WHEN n.m < o.m THEN 'cheaper' WHEN n.m > o.m THEN 'dearer' ELSE 'same' END AS verdict FROM s o JOIN s n ON o.task = n.task WHERE NOT o.v AND n.v"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (name_rules, NAME_RULES), (whole_identifiers, WHOLE_IDENTIFIERS), (definition_lines, DEFINITION_LINES), (label_forms, LABEL_FORMS), (folder_listing, FOLDER_LISTING), (expanded_lines, EXPANDED_LINES),
        (fenced_blocks, FENCED_BLOCKS), (table_views, TABLE_VIEWS), (cut_texts, CUT_TEXTS), (conflict_functions, CONFLICT_FUNCTIONS), (overlapping_edits, OVERLAPPING_EDITS), (impact_totals, IMPACT_TOTALS),
        (ranked_callers, RANKED_CALLERS), (near_names, NEAR_NAMES), (module_names, MODULE_NAMES), (code_members, CODE_MEMBERS), (test_suites, TEST_SUITES), (edit_errors, EDIT_ERRORS), (project_manifests, PROJECT_MANIFESTS),
        (structured_outlines, STRUCTURED_OUTLINES), (code_grok, CODE_GROK), (code_around, CODE_AROUND), (code_fingerprint, CODE_FINGERPRINT), (moved_symbols, MOVED_SYMBOLS), (diff_attribution, DIFF_ATTRIBUTION),
        (tool_ratios, TOOL_RATIOS), (version_report, VERSION_REPORT),
    )
}
