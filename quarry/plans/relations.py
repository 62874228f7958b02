"""Queries over edges, versions, runs and events: joins and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, graph, rollup, stats
from ..sources import documents
from . import corpus as C


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.histogram(C.files(spark, sf_dir), "lang")


LANGUAGE_HISTOGRAM = "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang"


def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.primary(C.files(spark, sf_dir), "source", "lang")


PRIMARY_LANGUAGE = "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE r = 1"


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.modules(C.files(spark, sf_dir))


MODULE_FILES = rf"""WITH {C.FILES_SQL}, m AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, count(*) AS files FROM files JOIN m USING (lang) GROUP BY 1 HAVING count(*) >= 2 ORDER BY files DESC, dir LIMIT 10"""


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and first path parts of links in pages."""
    links = C.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="/([a-zA-Z]+)'), F.lit(1))).alias("symbol"))
    return links.withColumn("target", F.substring("symbol", 1, 2))


def hot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hot_targets(_imports(spark, sf_dir))


HOT_TARGETS = """WITH l AS (SELECT url AS path, unnest(regexp_extract_all(html, 'href="/([a-zA-Z]+)', 1)) AS symbol FROM pages), i AS (SELECT *, substr(symbol, 1, 2) AS target FROM l),
c AS (SELECT target, count(DISTINCT path) AS importers FROM i GROUP BY target HAVING count(DISTINCT path) >= 2),
s AS (SELECT target, symbol, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, symbol) AS r FROM i GROUP BY 1, 2)
SELECT c.target, importers, symbol FROM c LEFT JOIN s ON c.target = s.target AND r = 1 ORDER BY importers DESC, c.target LIMIT 5"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as call sites: a customer calls a priority, a nation's customers call the nation."""
    o = C.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_orderkey").alias("line"), F.concat(F.lit("c"), "o_custkey").alias("callee"), F.concat(F.lit("p"), F.col("o_custkey") % 97).alias("caller"))
    p = C.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("line"), F.concat(F.lit("p"), F.col("o_custkey") % 97).alias("callee"), F.concat(F.lit("n"), F.col("o_custkey") % 7).alias("caller"))
    return o.union(p)


CALLS_SQL = """calls AS (SELECT o_orderstatus AS path, o_orderkey AS line, concat('c', o_custkey) AS callee, concat('p', o_custkey % 97) AS caller FROM orders
  UNION ALL SELECT o_orderpriority, o_orderkey, concat('p', o_custkey % 97), concat('n', o_custkey % 7) FROM orders)"""


def callers_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.callers(_calls(spark, sf_dir), names)


CALLERS_BATCH = f"WITH {CALLS_SQL} SELECT * FROM calls WHERE callee IN (SELECT concat('c', c_custkey) FROM customer)"


def callers_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.table(spark, sf_dir, "customer").where("c_custkey IN (1, 2, 4, 5)").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.impact(_calls(spark, sf_dir), names)


CALLERS_TWO_HOP = f"""WITH {CALLS_SQL}, f AS (SELECT * FROM calls WHERE callee IN ('c1', 'c2', 'c4', 'c5')), n AS (SELECT DISTINCT caller FROM f),
s AS (SELECT c.* FROM calls c WHERE callee IN (SELECT caller FROM n) AND (SELECT count(*) FROM n) BETWEEN 1 AND 10 AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = c.path AND f.line = c.line)),
r AS (SELECT *, row_number() OVER (PARTITION BY caller, path ORDER BY line, callee) AS k FROM s)
SELECT callee, path, line, caller, 1::BIGINT AS hop FROM f UNION ALL SELECT callee, path, line, caller, 2::BIGINT FROM r WHERE k = 1"""


def reachability_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers reach: supplier, nation, region, and from a region its next."""
    s = C.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = C.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    r = C.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("r"), F.col("r_regionkey") + 1).alias("dst"))
    start = C.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.reachable(s.union(n).union(r), start)


REACHABILITY_RECURSIVE = """WITH RECURSIVE e AS (SELECT concat('s', s_suppkey) AS src, concat('n', s_nationkey) AS dst FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation
  UNION ALL SELECT concat('r', r_regionkey), concat('r', r_regionkey + 1) FROM region),
w AS (SELECT concat('s', s_suppkey) AS node, 0 AS hop FROM supplier UNION ALL SELECT e.dst, w.hop + 1 FROM w JOIN e ON w.node = e.src WHERE w.hop < 11)
SELECT node, min(hop)::BIGINT AS hop FROM w GROUP BY node"""


def two_hop_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    b = C.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    start = C.table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.two_hops(e.union(b), start)


TWO_HOP_CALLEES = """WITH e AS (SELECT DISTINCT concat('o', l_orderkey) AS src, concat('p', l_partkey) AS dst FROM lineitem UNION SELECT concat('p', p_partkey), p_brand FROM part),
a AS (SELECT concat('o', o_orderkey) AS root, dst AS node FROM orders JOIN e ON src = concat('o', o_orderkey) WHERE o_orderkey % 100 = 0),
h AS (SELECT root, node, 1 AS hop FROM a UNION ALL SELECT root, e.dst, 2 FROM a JOIN e ON a.node = e.src)
SELECT root, node, min(hop)::BIGINT AS hop FROM h WHERE node <> root GROUP BY root, node"""


def prioritised_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the first supplier: of the most line items, then by key."""
    li = C.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    names = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return graph.resolve(names, li, ["l_partkey"], [F.desc("n"), F.col("l_suppkey")])


PRIORITISED_RESOLUTION = "SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1 AND l_partkey IN (SELECT p_partkey FROM part)"


def used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.used_by(_calls(spark, sf_dir), names, "F").select("path", "caller", "line", F.array_join("symbols", ",").alias("symbols"))


USED_BY = f"""WITH {CALLS_SQL}, n AS (SELECT concat('c', c_custkey) AS name FROM customer ORDER BY octet_length(encode(name)) DESC, name LIMIT 25)
SELECT path, caller, min(line) AS line, array_to_string(list_sort(list(DISTINCT callee)), ',') AS symbols FROM calls JOIN n ON callee = name WHERE path <> 'F' GROUP BY path, caller"""


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = C.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.blast(_calls(spark, sf_dir), touched, F.col("path") == "O")


BLAST_RADIUS = f"""WITH {CALLS_SQL} SELECT callee, count(*) FILTER (path <> 'O') AS production, count(*) FILTER (path = 'O') AS tests, count(DISTINCT path) AS files
FROM calls WHERE callee IN (SELECT concat('c', c_custkey) FROM customer) GROUP BY callee"""


def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return rollup.duplicates(d, ["digest"])


EXACT_DUP_DOCS = "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


def identity_match_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols; new side: some gone, some renamed, some changed."""
    f = C.files(spark, sf_dir).select("doc_id", F.col("source").alias("path"), "lang", F.col("text"))
    name = F.concat(F.lit("f"), "doc_id")
    at = F.col("doc_id").cast("int")

    def side(which: str, rows: DataFrame, named, body) -> DataFrame:
        return rows.select(
            F.lit(which).alias("side"), "path", F.lit("function").alias("kind"), F.col("lang").alias("parent_path"), named.alias("name"), at.alias("start_line"), F.concat(named, F.lit("()")).alias("signature"),
            F.xxhash64(body, named).alias("content_hash"), F.xxhash64(body).alias("structural_hash"), body.alias("source_text"),
        )

    old = side("old", f, name, F.concat("text", F.lit("#"), "doc_id"))
    body = F.when(F.col("doc_id") % 10 == 2, F.reverse("text")).otherwise(F.concat("text", F.lit("#"), "doc_id"))
    renamed = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("g"), "doc_id")).otherwise(name)
    new = side("new", f.where("doc_id % 10 <> 1"), renamed, body)
    return diff.match_versions(old.union(new)).groupBy("change", "confidence").agg(F.count("*").alias("n"))


IDENTITY_MATCH_DIFF = """SELECT CASE doc_id % 10 WHEN 1 THEN 'deleted' WHEN 2 THEN 'body_changed' WHEN 3 THEN 'renamed' ELSE 'unchanged' END AS change,
  CASE doc_id % 10 WHEN 3 THEN 'structural' ELSE 'exact' END AS confidence, count(*) AS n FROM documents GROUP BY 1, 2"""


def fuzzy_match_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of a file each: the new side has another name and a slightly longer text; some files hold twins on both sides, which nobody can tell apart."""
    p = C.table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    twin = F.col("p_partkey") % 5 == 0

    def side(which: str, names: str, extra: str) -> DataFrame:
        each = p.select("p_partkey", text.alias("body"), twin.alias("twin"), F.explode(F.when(twin, F.array(*map(F.lit, names))).otherwise(F.array(F.lit(names[0])))).alias("name"))
        body = F.concat("body", F.lit(extra))
        return each.select(
            F.lit(which).alias("side"), F.concat(F.lit("f"), "p_partkey").alias("path"), F.lit("function").alias("kind"), F.lit("").alias("parent_path"), "name", F.ascii("name").alias("start_line"), F.lit("()").alias("signature"),
            F.xxhash64("name", body).alias("content_hash"), F.when(F.col("twin"), F.xxhash64("p_partkey")).otherwise(F.xxhash64(body)).alias("structural_hash"), body.alias("source_text"),
        )

    found = diff.match_versions(side("old", "ab", "").union(side("new", "cd", " x")))
    found = found.withColumn("mark", diff.marker(F.col("change"), F.col("confidence")))
    return found.groupBy("change", "confidence", "n_ambiguous", "mark").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


FUZZY_MATCH_DIFF = r"""WITH p AS (SELECT p_partkey % 5 = 0 AS twin, concat_ws(' ', p_name, p_brand, p_type) AS t FROM part),
s AS (SELECT twin, length(regexp_replace(t, '\s+', '', 'g')) AS n, octet_length(encode(t)) AS b FROM p),
d AS (SELECT twin, CASE WHEN b >= 0.8 * (b + 2) THEN 2.0::DOUBLE * (n - 1) / (2 * n - 1) ELSE 0 END AS score FROM s),
r AS (SELECT CASE WHEN twin THEN 'twin' WHEN score >= 0.8 THEN 'like' ELSE 'not' END AS r, score FROM d),
o AS (SELECT 'renamed' AS change, 'fuzzy' AS confidence, NULL::BIGINT AS n_ambiguous, '[→]' AS mark, count(*) AS n, round(sum(score), 6) AS score FROM r WHERE r = 'like'
  UNION ALL SELECT c, 'ambiguous', 2, '[?→]', 2 * count(*), NULL FROM r, (VALUES ('deleted'), ('added')) v(c) WHERE r = 'twin' GROUP BY c
  UNION ALL SELECT c, 'exact', NULL, m, count(*), NULL FROM r, (VALUES ('deleted', '[-]'), ('added', '[+]')) v(c, m) WHERE r = 'not' GROUP BY c, m)
SELECT * FROM o WHERE n > 0"""


def json_keys_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as JSON files: their keys, kinds and sizes."""
    files = C.table(spark, sf_dir, "events").select(F.concat("event_id", F.lit(".json")).alias("path"), F.col("props").alias("text"))
    return documents.outline(files).groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


JSON_KEYS_VIEW = """WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events), v AS (SELECT key, json_type(props, concat('$.', key)) AS t, json_extract_string(props, concat('$.', key)) AS s FROM k)
SELECT key, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n, sum(CASE t WHEN 'VARCHAR' THEN length(s) ELSE 1 END)::BIGINT AS size FROM v GROUP BY 1, 2"""


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    found = stats.session_summary(e, "event_type", "user", "event_type")
    return found["counts"].select(F.lit("kind").alias("what"), F.col("event_type").alias("name"), "n").union(found["queries"].select(F.lit("top"), "user", "n"))


SESSION_SUMMARY = """SELECT 'kind' AS what, event_type AS name, count(*) AS n FROM events GROUP BY event_type
UNION ALL (SELECT 'top', user_id::VARCHAR, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, user_id::VARCHAR LIMIT 5)"""


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 10).alias("b"), (F.col("event_id") % 900).alias("s"))
    return stats.savings(e, "b", "s", ["event_type"])


SAVINGS = """WITH e AS (SELECT event_type, floor(value * 10)::BIGINT AS b, event_id % 900 AS s FROM events), t AS (SELECT event_type, sum(b)::BIGINT AS baseline, sum(greatest(b - s, 0))::BIGINT AS saved FROM e GROUP BY 1)
SELECT event_type, baseline, saved, CASE WHEN baseline = 0 THEN 0 ELSE floor(saved * 100 / baseline) END::BIGINT AS percent FROM t"""


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stats.summary(C.table(spark, sf_dir, "events"), ["event_type"], "value")
    return e.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "stdev", "min", "max")])


BENCH_STATS = "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type"


def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.median_of_medians(C.table(spark, sf_dir, "events"), ["event_type"], ["user_id"], "value")
    return m.select("event_type", F.round("median", 6).alias("median"), "groups")


MEDIAN_OF_MEDIANS = "SELECT event_type, round(median(m), 6) AS median, count(*) AS groups FROM (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1"


def upper_median_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(C.table(spark, sf_dir, "events"), ["user_id"], [F.col("value"), F.col("event_id")]).select("user_id", "event_id")


UPPER_MEDIAN_RUN = "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = n // 2 + 1"


def dense_tool_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    runs = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("tool_calls"))
    return stats.dense_median(runs, "user_id", "tool_calls")


DENSE_TOOL_MEDIAN = """WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type AS name FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT name, median(coalesce(n, 0))::DOUBLE AS median FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.name GROUP BY name"""


def cost_per_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "purchase")
    r = stats.cost_per_correct(e.withColumn("g", F.col("user_id") % 40), ["g"], "ok", "value")
    return r.select("g", "runs", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("spend", 4).alias("spend"), F.round("cost_per_correct", 4).alias("cost_per_correct"))


COST_PER_CORRECT = """SELECT user_id % 40 AS g, count(*) AS runs, sum((event_type = 'purchase')::INT)::BIGINT AS correct, round(sum((event_type = 'purchase')::INT) / count(*), 6) AS accuracy, round(sum(value), 4) AS spend,
  round(sum(value) / nullif(sum((event_type = 'purchase')::INT), 0), 4) AS cost_per_correct FROM events GROUP BY 1"""


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9000).alias("input_tokens"), (F.col("user_id") % 700).alias("output_tokens"))
    return stats.token_cost(li, {"input_tokens": 3.0, "output_tokens": 15.0}).select("event_id", F.round("token_cost", 9).alias("token_cost"))


TOKEN_COSTS = "SELECT event_id, round(event_id % 9000 * 3.0::DOUBLE / 1e6 + user_id % 700 * 15.0::DOUBLE / 1e6, 9) AS token_cost FROM events"


def percent_delta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate").cast("string")).withColumn("q", F.col("l_quantity").cast("long"))
    r = stats.compared(li, ["l_returnflag", "l_linestatus"], "y", "1996", "1997", F.col("q"))
    return r.withColumn("delta_percent", F.round("delta_percent", 6))


PERCENT_DELTA_JOIN = """WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT) FILTER (year(l_shipdate) = 1996)::BIGINT AS old, sum(l_quantity::BIGINT) FILTER (year(l_shipdate) = 1997)::BIGINT AS new FROM lineitem GROUP BY 1, 2)
SELECT *, round(CASE WHEN old = 0 THEN 0.0 ELSE (new - old) * 100.0::DOUBLE / old END, 6) AS delta_percent FROM s WHERE old IS NOT NULL AND new IS NOT NULL"""


def zipped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    return stats.zipped(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], ["event_id"], ["event_id"])


ZIPPED_RUNS = """WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events)
SELECT a.user_id, a.nth, a.event_id AS old_event_id, b.event_id AS new_event_id FROM n a JOIN n b ON a.user_id = b.user_id AND a.nth = b.nth WHERE a.event_type = 'view' AND b.event_type = 'click'"""


def tool_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return stats.mix(e.where("user_id % 2 = 0 AND event_type <> 'signup'"), e.where("user_id % 2 = 1 AND event_type <> 'error'"), "event_type", "one")


TOOL_MIX = """SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND event_type <> 'signup') AS old, count(*) FILTER (user_id % 2 = 1 AND event_type <> 'error') AS new FROM events GROUP BY 1
HAVING count(*) FILTER (user_id % 2 = 0 AND event_type <> 'signup') + count(*) FILTER (user_id % 2 = 1 AND event_type <> 'error') > 0"""


def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").alias("v")))).alias("x"))
    return e.select("user_id", stats.sparkline(F.transform("x", lambda x: x["v"]), "012345678").alias("line"))


SPARKLINES = """WITH e AS (SELECT user_id, event_id, floor(value)::BIGINT AS v FROM events), m AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS a, max(v) OVER (PARTITION BY user_id) AS b FROM e)
SELECT user_id, string_agg(CASE WHEN a = b THEN '0' ELSE least(floor((v - a)::DOUBLE / (b - a) * 8), 8)::INT::VARCHAR END, '' ORDER BY event_id) AS line FROM m GROUP BY user_id"""


def multiset_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of odd users' events as errors after an edit, beyond as many equal ones of even users, by user group."""
    e = C.table(spark, sf_dir, "events")
    side = lambda r: e.where(f"user_id % 2 = {r}").select(F.col("event_id").alias("line"), F.col("event_type").alias("kind"), F.floor(F.col("user_id") / 10).cast("long").alias("detail"))
    return diff.new_errors(side(0), side(1), ["kind", "detail"]).groupBy("kind", "detail").agg(F.count("*").alias("n"), F.min("line").alias("first"))


MULTISET_EXCEPT = """WITH b AS (SELECT event_type AS kind, user_id // 10 AS detail, count(*) AS had FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2),
a AS (SELECT event_type AS kind, user_id // 10 AS detail, event_id AS line, row_number() OVER (PARTITION BY event_type, user_id // 10 ORDER BY event_id) AS nth FROM events WHERE user_id % 2 = 1)
SELECT kind, detail, count(*) AS n, min(line) AS first FROM a LEFT JOIN b USING (kind, detail) WHERE nth > coalesce(had, 0) GROUP BY 1, 2"""


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("source"), F.col("event_id").alias("line"))
    return rollup.import_summary(e, 3)


IMPORT_SUMMARY = """SELECT * FROM (SELECT user_id::VARCHAR AS path, event_type AS source, count(*) AS n, min(event_id) AS line, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type) AS nth, count(*) OVER (PARTITION BY user_id) AS total
FROM events GROUP BY 1, 2, user_id) WHERE nth <= 3"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (language_histogram, LANGUAGE_HISTOGRAM), (primary_language, PRIMARY_LANGUAGE), (module_files, MODULE_FILES), (hot_targets, HOT_TARGETS), (callers_batch, CALLERS_BATCH),
        (callers_two_hop, CALLERS_TWO_HOP), (reachability_recursive, REACHABILITY_RECURSIVE), (two_hop_callees, TWO_HOP_CALLEES), (prioritised_resolution, PRIORITISED_RESOLUTION),
        (used_by, USED_BY), (blast_radius, BLAST_RADIUS), (exact_dup_docs, EXACT_DUP_DOCS), (identity_match_diff, IDENTITY_MATCH_DIFF), (fuzzy_match_diff, FUZZY_MATCH_DIFF), (json_keys_view, JSON_KEYS_VIEW),
        (session_summary, SESSION_SUMMARY), (savings, SAVINGS), (bench_stats, BENCH_STATS), (median_of_medians, MEDIAN_OF_MEDIANS), (upper_median_run, UPPER_MEDIAN_RUN),
        (dense_tool_median, DENSE_TOOL_MEDIAN), (cost_per_correct, COST_PER_CORRECT), (token_costs, TOKEN_COSTS), (percent_delta_join, PERCENT_DELTA_JOIN), (zipped_runs, ZIPPED_RUNS),
        (tool_mix, TOOL_MIX), (sparklines, SPARKLINES), (multiset_except, MULTISET_EXCEPT), (import_summary, IMPORT_SUMMARY),
    )
}
