"""Operators on fixtures: text functions, lines, diffs, trees, documents, packing, streams."""

import os

import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import ranking, rules
from quarry.functions import text as T
from quarry.operators import diff, graph, lines, pack, search, stats
from quarry.sources import codefs, documents


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text_functions(spark):
    s = F.lit
    got = one(spark, T.fnv12(s("  let x = compute();")), T.fnv12(s("")), T.token_estimate(s("é1234")), T.size_label(s(1536)), T.age_label(s(7300)), T.normalized_path(s("a/./b/../../c//d")), T.shared_depth(s("a/b/c.rs"), s("a/b/d.rs")), T.shared_depth(s("a/x/c.rs"), s("a/b/d.rs")))
    assert list(got) == [0x384, 0xDC5, 2, "1KB", "2h", "c/d", 2, 1]
    got = one(spark, T.whole_word(s("un café x"), "café"), T.whole_word(s("le réeau"), "ré"), T.dice(T.bigrams(s("night")), T.bigrams(s("nacht"))), T.heading_level(s("### A ##")), T.heading_text(s("### A ##")), T.anchor(s(3), s("")))
    assert list(got) == [True, False, 0.25, 3, "A", "3:dc5"]


@pytest.mark.parametrize(("q", "kind"), [("/fn .*x/", "regex"), ("/src/", "path"), ("*.rs", "glob"), ("src/a.rs", "path"), ("404", "content"), ("handleAuth", "symbol"), ("is_ok", "symbol"), ("alias", "concept"), ("cli mode", "concept"), ("a b c d e", "content"), ("TODO: fix this/that", "content")])
def test_classify(spark, q, kind):
    assert one(spark, rules.classify(F.lit(q)))[0] == kind


def test_ranking_preferences(spark):
    rows = spark.createDataFrame([("src/auth.rs", "pub fn auth() {", True, 100, "auth"), ("src/x.rs", "auth();", False, 0, None), ("docs/auth.md", "auth is", False, 0, None), ("src/y.rs", "// auth", False, 0, None), ("vendor/z.rs", "auth();", False, 0, None), ("src/a.test.ts", "auth()", False, 0, None)], "path string, text string, is_definition boolean, def_weight int, def_name string").withColumn("line", F.lit(1))
    order = [r["path"] for r in search.top(search.ranked(rows, "auth")).collect()]
    assert order[0] == "src/auth.rs" and order.index("src/x.rs") < order.index("src/y.rs") and order.index("src/x.rs") < order.index("vendor/z.rs") and order.index("src/x.rs") < order.index("src/a.test.ts")
    assert one(spark, ranking.incidental_penalty(F.lit("x(); // auth"), F.lit("a.rs"), F.lit(False), "auth"), ranking.incidental_penalty(F.lit("see http://auth"), F.lit("a.rs"), F.lit(False), "auth"))[:] == (100, 0)


def test_lines(spark):
    f = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", "z"), ("d", "\n\n\n1\n\n2"), ("e", None)], "path string, text string")
    rows = lines.lines(f)
    assert [(r["path"], r["line"], r["text"]) for r in rows.where("path IN ('a', 'b', 'c')").orderBy("path", "line").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, "z")]
    assert [r["line"] for r in lines.collapse_blanks(rows.where("path = 'd'"), ["path"]).orderBy("line").collect()] == [1, 4, 5, 6]
    picked = spark.createDataFrame([("p", n) for n in (50, 55, 56, 57, 58, 63, 70, 71)], "path string, line int")
    assert lines.run_list(picked, ["path"]).first()["lines"] == "50,55-58,63,70,71"
    code = spark.createDataFrame([("m.py", i + 1, t) for i, t in enumerate(["x = 1", "print(x)", "# plain", "# TODO: y", "", "", "y = 2"])], "path string, line int, text string")
    assert [r["line"] for r in lines.strip_noise(code, ["path"], F.lit("python")).orderBy("line").collect()] == [1, 4, 5, 7]


PATCH = """diff --git a/a b.txt b/a b.txt
--- a/a b.txt
+++ b/a b.txt
@@ -1,3 +1,3 @@
 keep
-old
+new
 end
@@ bad @@
+lost
diff --git a/x.bin b/x.bin
new file mode 100644
Binary files /dev/null and b/x.bin differ
diff --git a/o.rs b/n.rs
rename from o.rs
rename to n.rs
"""


def test_diff_parser(spark):
    rows = diff.diff_lines(spark.createDataFrame([(1, PATCH)], "patch_id long, text string")).orderBy("file_id", "hunk_no", "idx").collect()
    assert [(r["path"], r["kind"], r["old_line"], r["new_line"]) for r in rows[:4]] == [("a b.txt", "context", 1, 1), ("a b.txt", "removed", 2, None), ("a b.txt", "added", None, 2), ("a b.txt", "context", 3, 3)]
    assert [(r["path"], r["old_path"], r["status"], r["is_binary"]) for r in rows[4:]] == [("x.bin", None, "added", True), ("n.rs", "o.rs", "renamed", False)]
    totals = diff.diff_counts(spark.createDataFrame(rows)).first()
    assert (totals["files"], totals["insertions"], totals["deletions"]) == (3, 1, 1)


def version(side, name, body, line=1, kind="function", path="a.rs", structure=None):
    return (side, path, kind, "", name, line, f"{name}()", body, structure or body, body)


def test_match_versions(spark):
    rows = [version("old", "same", "b0"), version("new", "same", "b0"), version("old", "f", "x1", 1), version("old", "f", "x2", 9), version("new", "f", "x2", 1), version("new", "f", "x1", 9)]
    rows += [version("old", "was", "r"), version("new", "is", "r"), version("old", "t1", "tw"), version("old", "t2", "tw"), version("new", "t3", "tw")]
    rows += [version("old", "p", "some long body of a function", structure="s1"), version("new", "q", "some long body of a functions", structure="s2"), version("old", "gone", "zzzz")]
    df = spark.createDataFrame(rows, "side string, path string, kind string, parent_path string, name string, start_line int, signature string, content_hash string, structural_hash string, source_text string")
    got = {(r["name"], r["change"], r["confidence"], r["n_ambiguous"]) for r in diff.match_versions(df).collect()}
    assert got == {("same", "unchanged", "exact", None), ("f", "unchanged", "exact", None), ("is", "renamed", "structural", None), ("t1", "deleted", "ambiguous", 2), ("t2", "deleted", "ambiguous", 2), ("t3", "added", "ambiguous", 2), ("q", "renamed", "fuzzy", None), ("gone", "deleted", "exact", None)}


def test_conflicts_and_errors(spark):
    text = ["a", "<<<<<<< ours", "1", "=======", "2", "=======", "3", ">>>>>>> theirs", "b"]
    rows = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "path string, line int, text string")
    assert [tuple(r) for r in diff.conflicts(rows, ["path"]).collect()] == [("f", 2, 6, 8)]
    e = lambda *lines: spark.createDataFrame([("error", "x", n) for n in lines], "kind string, detail string, line int")
    assert [r["line"] for r in diff.new_errors(e(1), e(1, 5, 9), ["kind", "detail"]).orderBy("line").collect()] == [5, 9]


def test_tree_source(spark, tmp_path):
    for p, c in {"a.rs": b"fn a() {}", ".hidden": b"h", "node_modules/x.js": b"x", "d/e/f.py": b"\xff\xfe", "d/b.min.js": b"m", "big.txt": b"z" * 5000}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    os.symlink(tmp_path / "d", tmp_path / "link")
    files = codefs.tree(spark, str(tmp_path))
    paths = sorted(r["path"] for r in files.collect())
    assert paths in ([".hidden", "a.rs", "big.txt", *x] for x in (["d/b.min.js", "d/e/f.py"], ["link/b.min.js", "link/e/f.py"]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert {r["path"] for r in codefs.tree(spark, str(tmp_path)).where("length < 1000 AND ext = 'rs'").collect()} == {"a.rs"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert {r["path"] for r in files.where("length < 1000 AND ext = 'rs'").collect()} == {"a.rs"}
    assert {r["path"] for r in codefs.tree(spark, str(tmp_path), glob="*.{rs,txt}").collect()} == {"a.rs", "big.txt"}
    assert {r["path"] for r in codefs.tree(spark, str(tmp_path), depth="1", hidden="false").collect()} == {"a.rs", "big.txt"}
    assert not any(r["path"].endswith("f.py") for r in codefs.texts(files).collect()) and codefs.texts(files, lossy=True).count() == files.count()
    assert [r["entry"] for r in codefs.listing(codefs.tree(spark, str(tmp_path / "d")), "").collect()] == ["b.min.js", "e/"]


def test_documents(spark):
    assert documents.manifest("Cargo.toml", '[package]\nname = "a"\nversion = "1"\n[dependencies]\nz = "1"\nb = "2"') == ("a", "1", ["b", "z"])
    assert documents.manifest("package.json", "{broken") == (None, None, [])
    f = spark.createDataFrame([("a.json", '{"b": {"c": [1]}, "a": "x"}'), ("c.yaml", "k: 1\nm:\n  n: 2\n"), ("t.toml", "[s]\nv = 1")], "path string, text string")
    got = {(r["path"], r["key"], r["kind"]) for r in documents.outline(f).collect()}
    assert {("a.json", "a", "string"), ("a.json", "b.c", "array"), ("c.yaml", "m.n", "string"), ("t.toml", "s.v", "number")} <= got


def test_globs(spark):
    paths = spark.createDataFrame([("src/a.rs",), ("src/x/b.ts",), ("b.md",)], "path string")
    got = lambda g: {r["path"] for r in search.glob(paths, g).collect()}
    assert got("src/**/*.ts") == {"src/x/b.ts"} and got("*.{rs,md}") == {"src/a.rs", "b.md"} and got("!*.md") == {"src/a.rs", "src/x/b.ts"} and got("[!ab].*") == set()
    with pytest.raises(ValueError, match="look-around"):
        search.checked("a(?=b)")


def test_intervals(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50)], "path string, line int")
    spans = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 4, 6, "inner")], "path string, start int, end int, name string")
    assert sorted((r["line"], r["name"]) for r in graph.innermost(points, spans, "path", "line", ["name"]).collect() if r["name"]) == [(5, "inner")]
    assert sorted((r["line"], r["name"]) for r in graph.first_enclosing(points, spans, "path", "line", ["name"]).collect() if r["name"]) == [(5, "outer")]


def test_stats_edges(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["median"], r["stdev"]) for r in stats.summary(rows, ["k"], "v").collect()}
    assert got == {"a": (1, 1.0, 0.0), "b": (0, 0.0, 0.0)}
    runs = spark.createDataFrame([(1, {"x": 2}), (2, {"x": 4, "y": 6}), (3, {})], "id int, t map<string,int>")
    assert {r["name"]: r["median"] for r in stats.dense_median(runs, "id", "t").collect()} == {"x": 2.0, "y": 0.0}


def first_fit(items, budget):
    used, taken = 0, []
    for v, i, t in sorted((-v, i, t) for i, (v, t) in enumerate(items)):
        if used + t <= budget:
            used, taken = used + t, [*taken, i]
    return sorted(taken)


@limits(max_examples=15, deadline=None)
@given(items=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), budget=st.integers(0, 20))
def test_first_fit(spark, items, budget):
    df = spark.createDataFrame([(items,)], "b array<struct<value:int,tokens:int>>")
    assert df.select(pack.first_fit(F.col("b"), budget)).first()[0] == first_fit(items, budget)


def test_budgets(spark):
    text = "intro\n\n## A\nbody\n\n## B\n" + "x" * 400
    cut = one(spark, pack.cut(F.lit(text), 60), pack.cut(F.lit("short"), 60), pack.degraded([F.lit("y" * 100), F.lit("z")], 10))
    assert cut[0].startswith("intro") and len(cut[0]) < len(text) and cut[1] == "short" and cut[2] == "z"


def test_streams(spark, tmp_path):
    from quarry.streaming import sessions

    events = spark.createDataFrame([(1, "2024-01-01 00:01:00", "view"), (1, "2024-01-01 00:02:00", "view"), (2, "2024-01-01 03:00:00", "click")], "user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.counts(stream).writeStream.format("memory").queryName("n").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["event_type"], r["n"]) for r in spark.table("n").collect()) == [("click", 1), ("view", 2)]


def test_targets():
    from quarry.functions import targets as t

    assert t.target("src/a.rs:12") == ("src/a.rs", 12, None) and t.target("A::b") == (None, None, "A::b")
    assert t.qualified("Auth.validate") == ("Auth", "validate") and t.qualified("std::path") == ("std", "path") and t.qualified("x") == (None, "x")
    assert t.pattern("/a.b/") == ("a.b", True) and t.line_range("3-9") == (3, 9) and t.line_range("9-3") is None and t.file_scope("a/b.rs:run") == ("a/b.rs", "run")
    assert t.anchored("a/../b", "/r") == "b"
    with pytest.raises(ValueError, match="outside"):
        t.anchored("../x", "/r")


def test_sinks_and_git(spark, tmp_path):
    import subprocess

    from quarry.sources import git, sinks

    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    batch = spark.createDataFrame([("a.py", "def hello():\n    pass\n"), ("d/b.py", "x = 1\n")], "path string, text string")
    assert sinks.write_back(batch, root, "create") == 2
    with pytest.raises(FileExistsError):
        sinks.write_back(batch, root, "create")
    with pytest.raises(ValueError, match="twice"):
        sinks.write_back(batch.union(spark.createDataFrame([("./a.py", "")], "path string, text string")), root)
    run("add", ".")
    run("commit", "-qm", "first change")
    sinks.write(f"{root}/a.py", "def hello():\n    return 1\n", "overwrite")
    rows = diff.diff_lines(git.diff(spark, root)).collect()
    assert {(r["kind"], r["content"]) for r in rows if r["kind"] != "context"} == {("removed", "    pass"), ("added", "    return 1")}
    old, new = git.sides(spark, root, ["a.py"])
    assert "pass" in old.first()["text"] and "return 1" in new.first()["text"]
    assert [r["subject"] for r in git.log(spark, root, "HEAD").collect()] == ["first change"]
    assert git.status(root, 5)[1] == 1 and git.git(root, "no-such-command") is None


def test_outlines_of_tests_and_blocks(spark):
    from quarry.functions import facts

    text = "describe('a', () => {\n  it('b', () => { x(); });\n  context('c', () => {\n    test('d', f);\n  });\n});\nit('e', g);\n"
    assert facts.test_outline(text) == [(1, 0, "suite", "a"), (2, 1, "test", "b"), (3, 1, "suite", "c"), (4, 2, "test", "d"), (7, 0, "test", "e")]
    rows = lines.lines(spark.createDataFrame([("m.md", "# A\n```\nx\n```\n~~~\ny\n")], "path string, text string"))
    assert lines.code_blocks(rows, ["path"]).first()["blocks"] == 2
    match = spark.createDataFrame([("m.md", 3, None, None)], "path string, line int, def_start int, def_end int")
    assert lines.expanded(rows, match).count() == 6
