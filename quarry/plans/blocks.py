"""Queries over lines of files: blocks, windows, budgets, labels, rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import diff, graph, lines, pack, rollup
from . import corpus as C

TOKENS = "((octet_length(encode(text)) + 3) // 4)::BIGINT"


def line_enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, within blocks of ten and of four lines: the innermost block."""
    rows = C.lines(spark, sf_dir)
    blocks = None
    for n, kind in ((10, "outer"), (4, "inner")):
        b = F.floor((F.col("line") - 1) / n)
        part = rows.groupBy("path", b.alias("b")).agg(F.min("line").alias("start"), F.max("line").alias("end")).select("path", "start", "end", F.lit(kind).alias("kind"))
        blocks = part if blocks is None else blocks.union(part)
    points = rows.where(F.contains("text", F.lit("thand"))).select("path", "line")
    return graph.innermost(points, blocks, "path", "line", ["kind", "start", "end"])


LINE_ENCLOSING_INTERVAL = f"""WITH {C.LINES_SQL},
b AS (SELECT path, min(line) AS s, max(line) AS e, 'outer' AS kind FROM lines GROUP BY path, (line - 1) // 10
  UNION ALL SELECT path, min(line), max(line), 'inner' FROM lines GROUP BY path, (line - 1) // 4),
p AS (SELECT path, line FROM lines WHERE contains(text, 'thand'))
SELECT path, line, kind, s AS start, e AS "end" FROM (SELECT p.path, p.line, kind, s, e, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s DESC, e, kind DESC) AS n
  FROM p JOIN b ON p.path = b.path AND p.line BETWEEN b.s AND b.e) WHERE n = 1"""


def line_run_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.run_list(C.lines(spark, sf_dir).where(F.contains("text", F.lit("the"))), ["path"])


LINE_RUN_COMPRESSION = f"""WITH {C.LINES_SQL}, m AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM lines WHERE contains(text, 'the')),
r AS (SELECT path, min(line) AS a, max(line) AS b, count(*) AS n FROM m GROUP BY path, i)
SELECT path, string_agg(CASE n WHEN 1 THEN a::VARCHAR WHEN 2 THEN concat(a, ',', b) ELSE concat(a, '-', b) END, ',' ORDER BY a) AS lines FROM r GROUP BY path"""


def neighbor_boost_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.diverse_lines(C.lines(spark, sf_dir), ["path"], "the", most=5, least=8).select("path", "line", "score")


NEIGHBOR_BOOST_TOP = rf"""WITH {C.LINES_SQL},
b AS (SELECT *, min(line) OVER (PARTITION BY path) AS a, max(line) OVER (PARTITION BY path) AS z, trim(text, ' ') AS t, contains(text, 'the')::INT AS h FROM lines),
c AS (SELECT path, line, (CASE WHEN line = a OR line = z THEN 100 WHEN t = '' OR regexp_matches(t, '^(//|#|/\*|\* )') OR t IN ('*/', '*') THEN 0
  WHEN regexp_matches(t, '^(if |\}} else|else |else\{{|match |switch |case |for |while |loop |loop\{{|return |return;)') OR t IN ('else', 'loop', 'return') OR regexp_matches(t, '\?;?$') OR contains(t, '(') THEN 10
  WHEN ends_with(t, '{{') AND length(t) > 1 THEN 5 WHEN contains(t, '=') OR regexp_matches(t, '^(let |const |var |mut )') THEN 1 ELSE 0 END
  + 50 * h + 5 * (coalesce(lag(h) OVER w, 0) + coalesce(lead(h) OVER w, 0)))::BIGINT AS score
  FROM b WHERE z - a >= 8 WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, line, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line) AS n FROM c) WHERE n <= 5"""


def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages, which have blank ones, without repeated blanks; and the gaps in what is left."""
    rows = lines.lines(C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.regexp_replace("html", "[<>]", "\n").alias("text")))
    return lines.gaps(lines.collapse_blanks(rows, ["path"]), ["path"], 0).groupBy("path").agg(F.count("*").alias("kept"), F.sum("skipped").alias("skipped"))


BLANK_COLLAPSE = r"""WITH l AS (SELECT page_id AS path, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '[<>]', chr(10), 'g'), '\n$', ''), chr(10)) AS p FROM pages WHERE length(html) > 0)),
b AS (SELECT path, line, trim(text, ' ') = '' AS blank, coalesce(lag(trim(text, ' ') = '') OVER (PARTITION BY path ORDER BY line), false) AS before FROM l),
k AS (SELECT path, line, line - coalesce(lag(line) OVER (PARTITION BY path ORDER BY line), 0) - 1 AS gap FROM b WHERE NOT (blank AND before))
SELECT path, count(*) AS kept, sum(gap)::BIGINT AS skipped FROM k GROUP BY path"""


def head_tail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of conversations as logs and of documents by the kind of their file (Go files as tables), and two thirds and one third of nine lines."""
    turns = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"))
    rows = C.lines(spark, sf_dir).select("path", "line")
    kind = F.when(F.endswith("path", F.lit(".go")), "tabular").when(F.contains("path", F.lit("/")), "other").otherwise("log")
    shown = lines.view(turns.union(rows), ["path"], kind).select("path", "line", "part", "total", F.lit("view").alias("how"))
    return shown.union(lines.body_slice(rows, ["path"], "line", 9).select("path", "line", "part", "total", F.lit("slice").alias("how")))


HEAD_TAIL_VIEW = f"""WITH {C.LINES_SQL},
a AS (SELECT conv_id::VARCHAR AS path, turn AS line, 10 AS h, 5 AS t, 'view' AS how FROM conversations
  UNION ALL SELECT path, line, CASE WHEN ends_with(path, '.go') THEN 6 ELSE 50 END, CASE WHEN ends_with(path, '.go') THEN 3 ELSE 10 END, 'view' FROM lines
  UNION ALL SELECT path, line, 6, 3, 'slice' FROM lines),
n AS (SELECT *, row_number() OVER (PARTITION BY path, how ORDER BY line) AS nth, count(*) OVER (PARTITION BY path, how) AS total FROM a)
SELECT path, line, CASE WHEN nth <= h THEN 'head' ELSE 'tail' END AS part, total, how FROM n WHERE nth <= h OR nth > total - t"""


def view_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.files(spark, sf_dir)
    length = F.octet_length("text")
    mode = rules.view_mode(length, F.col("text"), F.col("path"), rules.is_binary(F.encode("text", "UTF-8")), F.lit(False), F.lit(500))
    return f.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


VIEW_LADDER = f"""SELECT CASE WHEN text = '' THEN 'empty' WHEN octet_length(encode(text)) >= 100000 AND length(regexp_replace(substr(text, 1, 2048), '[^\\n]', '', 'g')) < 2 THEN 'minified'
  WHEN octet_length(encode(text)) > 500000 THEN 'oversize' WHEN {TOKENS} <= 6000 OR 50000 >= {TOKENS} * 80 THEN 'full' ELSE 'outline' END AS mode, count(*) AS n, sum({TOKENS})::BIGINT AS tokens FROM documents GROUP BY 1"""


def token_budget_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.files(spark, sf_dir).select("source", "path", T.token_estimate(F.col("text")).alias("tokens"))
    return lines.within_budget(f, ["source"], ["path"], "tokens", 24_000).select("source", "path", "tokens", "running")


TOKEN_BUDGET_CUMULATIVE = f"""WITH {C.FILES_SQL} SELECT * FROM (SELECT source, path, {TOKENS} AS tokens, (sum({TOKENS}) OVER (PARTITION BY source ORDER BY path))::BIGINT AS running FROM files) WHERE running <= 24000"""


def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.directory_totals(C.files(spark, sf_dir).select("path", T.token_estimate(F.col("text")).alias("tokens")), "tokens")


TOKEN_ROLLUP = f"""WITH {C.FILES_SQL}, p AS (SELECT string_split(path, '/') AS p, {TOKENS} AS tokens FROM files),
d AS (SELECT array_to_string(p[1:i], '/') AS dir, tokens FROM p, LATERAL (SELECT unnest(range(0, len(p))) AS i) r)
SELECT dir, sum(tokens)::BIGINT AS total, count(*) AS files FROM d GROUP BY dir"""


def stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files without debug logs, plain comments and repeated blanks: every third line is made one of these."""
    i = F.col("line") % 9
    made = F.when(i == 2, "  // note: kept").when(i == 3, "  # plain").when(i == 5, "").when(i == 6, "  ").when(i == 8, 'print("x")').otherwise(F.col("text"))
    rows = C.lines(spark, sf_dir).withColumn("text", made)
    return lines.strip_noise(rows, ["path"], rules.language(F.col("path"))).groupBy("path").agg(F.count("*").alias("kept"), F.sum("line").alias("total"))


STRIPPED_LINES = rf"""WITH {C.LINES_SQL}, m AS (SELECT path, line, regexp_extract(path, '\.([^./]+)$', 1) AS x, CASE line % 9 WHEN 2 THEN '  // note: kept' WHEN 3 THEN '  # plain' WHEN 5 THEN '' WHEN 6 THEN '  ' WHEN 8 THEN 'print("x")' ELSE text END AS text FROM lines),
b AS (SELECT *, trim(text, ' ') AS t, trim(text, ' ') = '' AS blank, coalesce(lag(trim(text, ' ') = '') OVER (PARTITION BY path ORDER BY line), false) AS before FROM m),
k AS (SELECT path, line FROM b WHERE NOT (blank AND before) AND NOT CASE WHEN regexp_matches(upper(t), 'TODO|FIXME|NOTE|HACK|SAFETY|WARN') THEN x = 'py' AND starts_with(t, 'print(') WHEN x = 'py' THEN starts_with(t, '#') OR starts_with(t, 'print(')
  WHEN x IN ('rs', 'go', 'js') THEN starts_with(t, '//') AND NOT (x = 'rs' AND (starts_with(t, '///') OR starts_with(t, '//!'))) ELSE false END)
SELECT path, count(*) AS kept, sum(line)::BIGINT AS total FROM k GROUP BY path"""


def labels_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return C.table(spark, sf_dir, "documents").select("doc_id", T.token_label(T.token_estimate(F.col("text"))).alias("tokens"), T.size_label(n * 37).alias("size"), T.age_label(n * 5).alias("age"))


LABELS_OF_SIZES = f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, {TOKENS} AS t FROM documents)
SELECT doc_id, CASE WHEN t < 1000 THEN concat('~', t) ELSE concat('~', t // 1000, '.', t % 1000 // 100, 'k') END AS tokens,
  CASE WHEN n * 37 < 1024 THEN concat(n * 37, 'B') WHEN n * 37 < 1048576 THEN concat(n * 37 // 1024, 'KB') ELSE concat(n * 37 // 1048576, '.', n * 37 % 1048576 * 10 // 1048576, 'MB') END AS size,
  CASE WHEN n * 5 < 60 THEN concat(n * 5, 's') WHEN n * 5 < 3600 THEN concat(n * 5 // 60, 'm') WHEN n * 5 < 86400 THEN concat(n * 5 // 3600, 'h') ELSE concat(n * 5 // 86400, 'd') END AS age FROM d"""


def fnv_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.lines(spark, sf_dir).select("path", "line", T.fnv12(F.col("text")).alias("hash"))
    return rows.withColumn("anchor", T.anchor_of(F.col("line"), F.col("hash")))


FNV_LINE_HASH = f"""WITH {C.LINES_SQL}, s AS (SELECT path, line, text, hex(encode(text)) AS h FROM lines),
f AS (SELECT path, line, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) & 4095)::BIGINT AS hash FROM s)
SELECT path, line, hash, concat(line, ':', lpad(lower(to_hex(hash)), 3, '0')) AS anchor FROM f"""


def _markdown(replace: str) -> str:
    """SQL for a page as Markdown: headings by their level, other tags as line ends."""
    out = "html"
    for n in range(1, 7):
        out = replace.format(out, f"<h{n}[^>]*>", f"concat(chr(10), '{'#' * n} ')")
    return replace.format(out, "<[^>]*>", "chr(10)")


def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages with the spans of their sections."""
    pages = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.expr(_markdown("regexp_replace({}, '{}', {})")).alias("text"))
    return lines.headings(lines.lines(pages), ["path"])


SECTION_OUTLINE = rf"""WITH m AS (SELECT page_id AS path, {_markdown("regexp_replace({}, '{}', {}, 'g')")} AS text FROM pages WHERE length(html) > 0),
l AS (SELECT path, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS p FROM m WHERE length(text) > 0)),
f AS (SELECT *, (sum(regexp_matches(text, '^ {{0,3}}(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line)) % 2 + regexp_matches(text, '^ {{0,3}}(```|~~~)')::INT AS open FROM l),
h AS (SELECT path, line, length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})([ \t]|$)', 1)) AS level, trim(regexp_replace(regexp_extract(text, '^ {{0,3}}#{{1,6}}[ \t]+(.*)$', 1), '[ \t]+#+[ \t]*$', ''), ' ') AS heading FROM f WHERE open = 0),
s AS (SELECT a.path, a.line, a.level, a.heading, min(b.line) AS stop FROM h a LEFT JOIN h b ON a.path = b.path AND b.line > a.line AND b.level BETWEEN 1 AND a.level WHERE a.level > 0 GROUP BY 1, 2, 3, 4)
SELECT s.path, s.line::BIGINT AS line, level::BIGINT AS level, heading, max(l.line)::BIGINT AS end_line FROM s JOIN l ON l.path = s.path AND l.line < coalesce(stop, 9223372036854775807) AND trim(l.text, ' ') <> '' GROUP BY 1, 2, 3, 4"""


def cumulative_edit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of their user's file."""
    i = F.col("event_id")
    e = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), i.alias("start"), (i + i % 7).alias("end"), (i % 11).alias("new_lines"))
    return diff.edit_offsets(e, ["path"]).select("path", "start", "offset", "overlaps")


CUMULATIVE_EDIT_OFFSET = """WITH e AS (SELECT user_id AS path, event_id AS s, event_id + event_id % 7 AS e, event_id % 11 AS n FROM events)
SELECT path, s AS start, coalesce(sum(n - (e - s + 1)) OVER (PARTITION BY path ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", coalesce(lag(e) OVER (PARTITION BY path ORDER BY s) >= s, false) AS overlaps FROM e"""


def hunk_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of their user's hunk."""
    kind = F.when(F.col("event_type") == "view", "added").when(F.col("event_type") == "click", "removed").otherwise("context")
    h = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("hunk_id"), F.col("event_id").alias("idx"), kind.alias("kind"), F.lit(10).alias("old_start"), F.lit(20).alias("new_start"))
    return diff.hunk_numbers(h).select("hunk_id", "idx", "kind", "old_line", "new_line")


HUNK_LINE_NUMBERS = """WITH h AS (SELECT user_id AS hunk_id, event_id AS idx, CASE event_type WHEN 'view' THEN 'added' WHEN 'click' THEN 'removed' ELSE 'context' END AS kind FROM events)
SELECT hunk_id, idx, kind, CASE WHEN kind <> 'added' THEN 10 + coalesce(sum((kind <> 'added')::INT) OVER w, 0) END::BIGINT AS old_line, CASE WHEN kind <> 'removed' THEN 20 + coalesce(sum((kind <> 'removed')::INT) OVER w, 0) END::BIGINT AS new_line
FROM h WINDOW w AS (PARTITION BY hunk_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def consecutive_usage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types in each user's events: gaps and islands."""
    e = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), "event_id", "event_type")
    found = lines.consecutive_groups(e, [F.col("event_id")], ["event_type"])
    return found.groupBy("q", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


CONSECUTIVE_USAGE_GROUPS = """WITH c AS (SELECT user_id AS q, event_id, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS new FROM events),
i AS (SELECT q, event_id, (sum(new) OVER (PARTITION BY q ORDER BY event_id))::BIGINT AS island FROM c) SELECT q, island, min(event_id) AS first, count(*) AS n FROM i GROUP BY q, island"""


def first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as result blocks within a budget: the dearest first, each if it still fits."""
    b = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("idx"), F.col("l_extendedprice").cast("long").alias("value"), F.col("l_quantity").cast("long").alias("tokens"))
    return pack.packed(b, ["q"], 60)


FIRST_FIT_PACKING = """WITH RECURSIVE b AS (SELECT l_orderkey AS q, l_linenumber::BIGINT AS idx, trunc(l_extendedprice)::BIGINT AS value, trunc(l_quantity)::BIGINT AS tokens FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY value DESC, idx, tokens) AS n FROM b),
f AS (SELECT q, 0::BIGINT AS n, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT q FROM b)
  UNION ALL SELECT f.q, o.n, CASE WHEN f.used + o.tokens <= 60 THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens <= 60 FROM f JOIN o ON f.q = o.q AND o.n = f.n + 1)
SELECT q, idx, value, tokens FROM o JOIN f USING (q, n) WHERE taken"""


def expand_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of each file, the ten best files."""
    m = C.lines(spark, sf_dir).where(F.contains("text", F.lit("thand")))
    return pack.expanded(m, [F.col("path"), F.col("line")], 10, True).select("path", "line")


EXPAND_BUDGET = f"WITH {C.LINES_SQL} SELECT path, min(line) AS line FROM lines WHERE contains(text, 'thand') GROUP BY path ORDER BY path LIMIT 10"


def package_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ancestor that holds a manifest, if some files are manifests."""
    f = C.files(spark, sf_dir).select(F.when(F.col("doc_id") % 50 == 0, F.concat(T.dirname(F.col("path")), F.lit("/go.mod"))).otherwise(F.col("path")).alias("path"))
    return rollup.package_roots(f.distinct(), ["go.mod", "setup.py"])


PACKAGE_ROOTS = rf"""WITH {C.FILES_SQL}, f AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN concat(regexp_replace(path, '/?[^/]*$', ''), '/go.mod') ELSE path END AS path FROM files),
r AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root FROM f WHERE regexp_extract(path, '[^/]*$') = 'go.mod')
SELECT f.path, (SELECT max_by(root, length(root)) FROM r WHERE starts_with(f.path, concat(root, '/'))) AS root FROM f"""


def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.files(spark, sf_dir).select("doc_id", F.concat(F.lit("./a/../"), F.regexp_replace("path", "/", "/./"), F.lit("/../x")).alias("p"))
    return p.select("doc_id", T.normalized_path(F.col("p")).alias("path"))


NORMALIZED_PATHS = rf"WITH {C.FILES_SQL} SELECT doc_id, concat(regexp_replace(path, '/?[^/]*$', ''), '/x') AS path FROM files"


def recency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(now, how="cross").groupBy(T.recency(F.col("ts").cast("timestamp"), F.col("now").cast("timestamp")).alias("points")).agg(F.count("*").alias("n"))


RECENCY_BUCKETS = """WITH a AS (SELECT epoch(max(ts) OVER ())::BIGINT - epoch(ts)::BIGINT AS age FROM events)
SELECT CASE WHEN age < 3600 THEN 100 WHEN age < 86400 THEN 80 WHEN age < 604800 THEN 50 WHEN age < 2592000 THEN 20 ELSE 0 END::BIGINT AS points, count(*) AS n FROM a GROUP BY 1"""


def outline_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows around each hit."""
    return lines.around(C.lines(spark, sf_dir), ["path"], F.contains("text", F.lit("thand"))).select("path", "line", "hit")


OUTLINE_CONTEXT = f"""WITH {C.LINES_SQL}, h AS (SELECT path, line, contains(text, 'thand') AS hit FROM lines),
n AS (SELECT *, max(hit::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h) SELECT path, line, hit FROM n WHERE near = 1"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (line_enclosing_interval, LINE_ENCLOSING_INTERVAL), (line_run_compression, LINE_RUN_COMPRESSION), (neighbor_boost_top, NEIGHBOR_BOOST_TOP), (blank_collapse, BLANK_COLLAPSE),
        (head_tail_view, HEAD_TAIL_VIEW), (view_ladder, VIEW_LADDER), (token_budget_cumulative, TOKEN_BUDGET_CUMULATIVE), (token_rollup, TOKEN_ROLLUP), (stripped_lines, STRIPPED_LINES), (labels_of_sizes, LABELS_OF_SIZES),
        (fnv_line_hash, FNV_LINE_HASH), (section_outline, SECTION_OUTLINE), (cumulative_edit_offset, CUMULATIVE_EDIT_OFFSET), (hunk_line_numbers, HUNK_LINE_NUMBERS),
        (consecutive_usage_groups, CONSECUTIVE_USAGE_GROUPS), (first_fit_packing, FIRST_FIT_PACKING), (expand_budget, EXPAND_BUDGET), (package_roots, PACKAGE_ROOTS), (normalized_paths, NORMALIZED_PATHS),
        (recency_buckets, RECENCY_BUCKETS), (outline_context, OUTLINE_CONTEXT),
    )
}
