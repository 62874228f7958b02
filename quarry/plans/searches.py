"""Search queries over documents as files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking, rules
from ..functions import text as T
from ..operators import diff
from ..operators import search as S
from . import corpus as C

PROXIMITY = "greatest(0, 200 - 20 * len(string_split(path, '/')))"
PENALTIES = """CASE WHEN regexp_matches(path, '\\.(md|mdx|txt|rst)$') OR list_has_any(string_split(path, '/'), ['docs', 'doc']) THEN 250 ELSE 0 END
  + CASE WHEN list_has_any(string_split(path, '/'), ['example', 'examples', 'sample', 'samples', 'template', 'templates']) AND regexp_matches(path, '\\.(md|txt|rst)$') THEN 80 ELSE 0 END
  + CASE WHEN contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__/') THEN 120 ELSE 0 END
  + CASE WHEN list_has_any(string_split(path, '/'), ['example', 'examples', 'mock', 'fixtures']) THEN 90 ELSE 0 END
  + CASE WHEN list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'dist', 'build', 'target', 'pkg', 'out']) THEN 200 ELSE 0 END"""
SCORE = f"({PROXIMITY} - ({PENALTIES}))::BIGINT"


def content_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.ranked(S.literal(C.lines(spark, sf_dir), "thand"), "thand")
    return S.top(found.withColumn("is_definition", F.lit(False)), 100).select("path", "line", "text", "score")


CONTENT_SEARCH_TOPK = f"WITH {C.LINES_SQL} SELECT path, line, text, {SCORE} AS score FROM lines WHERE contains(text, 'thand') ORDER BY score DESC, path, line LIMIT 100"


def usage_word_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.usages(C.lines(spark, sf_dir), "ré").groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("first"))


USAGE_WORD_BOUNDARY = rf"WITH {C.LINES_SQL} SELECT path, count(*) AS n, min(line) AS first FROM lines WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])ré($|[^\p{{L}}\p{{N}}_])') GROUP BY path"


def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regex(C.lines(spark, sf_dir), r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").select("path", "line")


REGEX_SEARCH = rf"WITH {C.LINES_SQL} SELECT path, line FROM lines WHERE regexp_matches(text, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}')"


def relaxed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.relaxed(C.lines(spark, sf_dir), "inging onthe").union(S.relaxed(C.lines(spark, sf_dir), "aiche enèque queci")).select("path", "line")


RELAXED_PHRASE = f"""WITH {C.LINES_SQL} SELECT path, line FROM lines WHERE regexp_matches(text, 'inging.*onthe|onthe.*inging')
UNION ALL SELECT path, line FROM lines WHERE contains(text, 'aiche') OR contains(text, 'enèque') OR contains(text, 'queci')"""


def multi_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.many(C.lines(spark, sf_dir), ["thand", "enest", "ciónes"]).select("q_idx", "q", "path", "line", "score", "nth")


MULTI_SYMBOL_SEARCH = rf"""WITH {C.LINES_SQL}, q AS (SELECT * FROM (VALUES (0, 'thand'), (1, 'enest'), (2, 'ciónes')) v(q_idx, q)),
m AS (SELECT q_idx, q, path, line, {SCORE} AS score FROM lines JOIN q ON contains(text, q) WHERE regexp_matches(text, concat('(^|[^\p{{L}}\p{{N}}_])', q, '($|[^\p{{L}}\p{{N}}_])')))
SELECT * FROM (SELECT q_idx::BIGINT AS q_idx, q, path, line, score, row_number() OVER (PARTITION BY q_idx ORDER BY score DESC, path, line) AS nth FROM m) WHERE nth <= 10"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file "defines" the first word of each line."""
    rows = C.lines(spark, sf_dir)
    return rows.select("path", "line", "text", F.regexp_extract("text", r"^(\p{L}+)", 1).alias("def_name"), F.when(F.col("line") == 1, 100).otherwise(30).alias("def_weight"))


def defs_union_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.symbol_matches(_definitions(spark, sf_dir), C.lines(spark, sf_dir), "The")
    return found.withColumn("stratum", ranking.stratum(F.col("is_definition"), F.col("def_weight"))).select("path", "line", "is_definition", "def_weight", "stratum")


DEFS_UNION_USAGES = rf"""WITH {C.LINES_SQL},
d AS (SELECT path, line, CASE WHEN line = 1 THEN 100 ELSE 30 END AS w FROM lines WHERE regexp_extract(text, '^(\p{{L}}+)', 1) = 'The'),
u AS (SELECT path, line FROM lines WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])The($|[^\p{{L}}\p{{N}}_])'))
SELECT path, line, true AS is_definition, w::BIGINT AS def_weight, CASE WHEN w >= 60 THEN 0 ELSE 1 END::BIGINT AS stratum FROM d
UNION ALL SELECT path, line, false, 0::BIGINT, 2::BIGINT FROM u ANTI JOIN d USING (path, line)"""


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(S.symbol_matches(_definitions(spark, sf_dir), C.lines(spark, sf_dir), "Of"))


SEARCH_TOTALS = rf"""WITH {C.LINES_SQL},
d AS (SELECT path, line FROM lines WHERE regexp_extract(text, '^(\p{{L}}+)', 1) = 'Of'),
u AS (SELECT path, line FROM lines WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])Of($|[^\p{{L}}\p{{N}}_])')),
n AS (SELECT (SELECT count(*) FROM d) AS d, (SELECT count(*) FROM u ANTI JOIN d USING (path, line)) AS u)
SELECT d + u AS total, d AS definitions, u AS usages FROM n"""


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.literal(C.lines(spark, sf_dir), "there")
    package = F.substring_index("path", "/", 2)
    return rows.select(S.facet(F.col("path"), F.col("text"), F.startswith("text", F.lit("There")), package, "src/src3").alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


FACET_COUNTS = f"""WITH {C.LINES_SQL} SELECT CASE WHEN starts_with(text, 'There') THEN 'definition'
  WHEN contains(path, '_test.') OR contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '_spec.') OR contains(path, '/spec/') THEN 'test'
  WHEN concat_ws('/', split_part(path, '/', 1), split_part(path, '/', 2)) = 'src/src3' THEN 'usage_local' ELSE 'usage_cross' END AS facet, count(*) AS n
FROM lines WHERE contains(text, 'there') GROUP BY 1"""


def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.files(spark, sf_dir).select("path", "text")
    return rows.select("path", ranking.score({"path": F.col("path"), "text": F.col("text")}, "mod_12").alias("score"))


RANK_SCORE = rf"""WITH {C.FILES_SQL}, s AS (SELECT path, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')) AS stem FROM files)
SELECT path, ({PROXIMITY} - ({PENALTIES}) + CASE WHEN stem = 'mod_12' THEN 500 WHEN starts_with(stem, 'mod_12') AND substr(stem, 7, 1) IN ('_', '.', '-') THEN 350
  WHEN ends_with(stem, 'mod_12') THEN 250 WHEN contains(stem, 'mod_12') THEN 180 ELSE 0 END)::BIGINT AS score FROM s"""


def rank_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of relevance: documents as matches of a name, with made-up lines, definitions, ages and sizes."""
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, "fn mod_12() {").when(i % 4 == 1, "export function y()").when(i % 4 == 2, "// mod_12 comment").otherwise("a = 1 // mod_12")
    m = {
        "path": F.col("path"), "text": text, "is_definition": i % 2 == 0, "def_weight": F.when(i % 3 == 0, 100).otherwise(40), "def_name": F.concat(F.lit("mod_"), (i % 20).cast("string")),
        "impl_target": F.when(i % 5 == 0, "mod_12").otherwise("x"), "exact": i % 7 == 0, "file_lines": (i % 400).cast("int"), "mtime": F.timestamp_seconds(F.lit(1_700_000_000) - i * 7_200),
    }
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    return C.files(spark, sf_dir).select("path", ranking.score(m, "mod_12", now, "src/src1/mod_0.rs").alias("score"))


RANK_TERMS = rf"""WITH {C.FILES_SQL}, s AS (SELECT path, doc_id AS i, concat('mod_', doc_id % 20) AS name, regexp_replace(path, '/?[^/]*$', '') AS dir,
  lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')) AS stem FROM files)
SELECT path, ({PROXIMITY} - ({PENALTIES}) + CASE WHEN stem = 'mod_12' THEN 500 WHEN starts_with(stem, 'mod_12') AND substr(stem, 7, 1) IN ('_', '.', '-') THEN 350
    WHEN ends_with(stem, 'mod_12') THEN 250 WHEN contains(stem, 'mod_12') THEN 180 ELSE 0 END
  + CASE WHEN i % 2 = 0 THEN 10 * CASE WHEN i % 3 = 0 THEN 100 ELSE 40 END ELSE 0 END + CASE WHEN i % 7 = 0 THEN 500 ELSE 0 END
  + CASE WHEN name = 'mod_12' THEN 220 WHEN i % 5 = 0 THEN 120 WHEN starts_with(name, 'mod_12') THEN 80 WHEN contains(name, 'mod_12') THEN 40 ELSE 0 END
  + CASE WHEN i % 4 IN (0, 1) THEN 70 ELSE 0 END + CASE WHEN i % 4 = 1 THEN 75 ELSE 0 END
  + CASE WHEN i % 400 BETWEEN 1 AND 199 THEN 50 ELSE 0 END
  + CASE WHEN i * 7200 < 3600 THEN 100 WHEN i * 7200 < 86400 THEN 80 WHEN i * 7200 < 604800 THEN 50 WHEN i * 7200 < 2592000 THEN 20 ELSE 0 END
  + CASE WHEN dir = 'src/src1' THEN 100 WHEN starts_with(concat(dir, '/'), 'src/src1/') THEN 40 ELSE 0 END
  - CASE WHEN i % 2 = 0 THEN 0 WHEN i % 4 = 3 THEN 100 ELSE 0 END)::BIGINT AS score FROM s"""


def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.table(spark, sf_dir, "part")
    texts = p.select(F.explode(F.array("p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"), F.concat(F.lit("src/"), "p_brand"), F.concat(F.lit("*."), "p_brand"), F.concat(F.lit("/"), "p_name", F.lit("+/")))).alias("q"))
    return texts.distinct().select(rules.classify(F.col("q")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


CLASSIFY_QUERIES = r"""WITH q AS (SELECT DISTINCT unnest([p_name, p_brand, p_type, p_partkey::VARCHAR, concat('src/', p_brand), concat('*.', p_brand), concat('/', p_name, '+/')]) AS q FROM part)
SELECT CASE WHEN length(q) >= 3 AND regexp_matches(q, '^/.+/$') AND regexp_matches(q[2:-2], '[()\[\]{}*+?|\\^$]') THEN 'regex'
  WHEN NOT contains(q, ' ') AND regexp_matches(q, '[*?{\[]') THEN 'glob'
  WHEN regexp_matches(q, '^\.\.?/') OR (contains(q, '/') AND NOT contains(q, ' ')) THEN 'path' WHEN regexp_full_match(q, '[0-9]*') THEN 'content'
  WHEN regexp_full_match(q, '[A-Za-z_$@][A-Za-z0-9_$.\-]*') THEN CASE WHEN regexp_matches(q, '^[A-Z]|::|[._-]|^[$@]|^[a-z].*[A-Z]') THEN 'symbol' ELSE 'concept' END
  WHEN contains(q, ' ') AND len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) <= 4
    AND len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[A-Za-z0-9_-]+'))) = 0 THEN 'concept' ELSE 'content' END AS kind, count(*) AS n
FROM q GROUP BY 1"""


def glob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.glob(C.files(spark, sf_dir).select("path"), "{src,lib}/**/*1?.{rs,test.js}", 20)


GLOB_FILES = rf"WITH {C.FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^(src|lib)/(.*/)?[^/]*1[^/]\.(rs|test\.js)$') ORDER BY path LIMIT 20"


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.files(spark, sf_dir)
    return f.groupBy(rules.file_type(F.col("path")).alias("file_type"), rules.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


FILE_TYPES = rf"""WITH {C.FILES_SQL} SELECT CASE x WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'other' ELSE 'code' END AS file_type,
  CASE x WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' END AS language, count(*) AS n
FROM (SELECT regexp_extract(path, '\.([^./]+)$', 1) AS x FROM files) GROUP BY 1, 2"""


def suggest_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.table(spark, sf_dir, "part").select("p_name").distinct()
    some = names.orderBy("p_name").limit(1).first()
    q = some["p_name"] if some else ""
    return S.did_you_mean(names, "p_name", q + "x", 3, 5)


SUGGEST_LEVENSHTEIN = """WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT concat(min(p_name), 'x') AS q FROM n)
SELECT p_name, levenshtein(p_name, q)::BIGINT AS distance FROM n, q WHERE levenshtein(p_name, q) <= 3 ORDER BY 2, 1 LIMIT 5"""


def external_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items that no English document uses."""
    word = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("name")).distinct()
    known = word(C.table(spark, sf_dir, "documents").where("lang = 'en'"))
    return word(C.table(spark, sf_dir, "benchmark")).join(known, "name", "left_anti")


EXTERNAL_SET_DIFFERENCE = """SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS name FROM benchmark
EXCEPT SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) FROM documents WHERE lang = 'en'"""


def fuzzy_pairs_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of benchmark items and documents of like length, by whole texts; items have no language, so documents of every language count."""
    items = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    documents = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return diff.similar_texts(items, documents).select("a", "b", F.round("score", 6).alias("score"))


FUZZY_PAIRS_DICE = r"""WITH b AS (SELECT item_id AS id, text AS t FROM benchmark), d AS (SELECT doc_id AS id, text AS t FROM documents),
p AS (SELECT b.id AS a, d.id AS b, b.t AS ta, d.t AS tb FROM b JOIN d ON least(octet_length(encode(b.t)), octet_length(encode(d.t))) >= 0.8 * greatest(octet_length(encode(b.t)), octet_length(encode(d.t)))),
x AS (SELECT DISTINCT a, regexp_replace(ta, '\s+', '', 'g') AS s FROM p), y AS (SELECT DISTINCT b, regexp_replace(tb, '\s+', '', 'g') AS s FROM p),
g AS (SELECT a, substr(s, i, 2) AS g, count(*) AS n FROM x, LATERAL (SELECT unnest(range(1, length(s))) AS i) r GROUP BY 1, 2),
h AS (SELECT b, substr(s, i, 2) AS g, count(*) AS n FROM y, LATERAL (SELECT unnest(range(1, length(s))) AS i) r GROUP BY 1, 2),
c AS (SELECT g.a, h.b, sum(least(g.n, h.n)) AS shared FROM g JOIN h ON g.g = h.g GROUP BY 1, 2)
SELECT p.a, p.b, round((2.0 * coalesce(shared, 0) / (length(x.s) - 1 + length(y.s) - 1))::DOUBLE, 6) AS score FROM p JOIN x USING (a) JOIN y USING (b) LEFT JOIN c ON p.a = c.a AND p.b = c.b"""


def grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.graded(C.table(spark, sf_dir, "conversations"), ["the", "In"], ["!!"]).select("conv_id", "turn", "correct")


GRADING = "SELECT conv_id, turn, contains(lower(replace(text, '`', '')), 'the') AND contains(lower(replace(text, '`', '')), 'in') AND NOT contains(lower(replace(text, '`', '')), '!!') AS correct FROM conversations"

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (content_search_topk, CONTENT_SEARCH_TOPK), (usage_word_boundary, USAGE_WORD_BOUNDARY), (regex_search, REGEX_SEARCH), (relaxed_phrase, RELAXED_PHRASE),
        (multi_symbol_search, MULTI_SYMBOL_SEARCH), (defs_union_usages, DEFS_UNION_USAGES), (search_totals, SEARCH_TOTALS), (facet_counts, FACET_COUNTS),
        (rank_score, RANK_SCORE), (rank_terms, RANK_TERMS), (classify_queries, CLASSIFY_QUERIES), (glob_files, GLOB_FILES), (file_types, FILE_TYPES), (suggest_levenshtein, SUGGEST_LEVENSHTEIN),
        (external_set_difference, EXTERNAL_SET_DIFFERENCE), (fuzzy_pairs_dice, FUZZY_PAIRS_DICE), (grading, GRADING),
    )
}
