"""Questions about a code base as plans over its facts.  All take files (path, text) and return a DataFrame with a total order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, rules
from ..functions import text as T
from ..sources import documents
from ..sources.cuts import cut
from . import diff, graph, lines, pack, rollup, search

MANIFESTS = ["Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.sbt", "mix.exs", "composer.json"]
CAPS = {"callees": 5, "callers": 5, "tests": 8, "siblings": 8}
FULL_CAPS = {"callees": 30, "callers": 50, "tests": 30, "siblings": 30}


@dataclass
class CodeBase:
    """Facts of one tree.  Symbols, calls and members come from one scan, written once, when a question first asks for any."""

    files: DataFrame

    @cached_property
    def searched(self) -> DataFrame:
        """Files that searches read: not too large, not minified."""
        small = self.files.where(F.octet_length("text") <= facts.MOST_BYTES)
        big = F.octet_length("text") >= 100_000
        return small.where(~rules.is_minified_name(F.col("path")) & ~(big & rules.is_minified_text(F.col("text"))))

    @cached_property
    def lines(self) -> DataFrame:
        return lines.lines(self.searched)

    @cached_property
    def facts(self) -> DataFrame:
        return cut(facts.scan(self.searched))

    @cached_property
    def symbols(self) -> DataFrame:
        return facts.of(self.facts, "symbols")

    @cached_property
    def definitions(self) -> DataFrame:
        code = facts.definitions_of(self.symbols)
        heads = self.sections.select("path", "line", F.col("heading").alias("text"), F.col("heading").alias("def_name"), F.lit(30).alias("def_weight"), F.col("line").alias("start_line"), "end_line", F.lit(None).cast("string").alias("impl_target"))
        return code.unionByName(heads)

    @cached_property
    def sections(self) -> DataFrame:
        """Headings of Markdown files with the span of their sections."""
        return lines.headings(self.lines.where(rules.file_type(F.col("path")) == "markdown"), ["path"])

    @cached_property
    def calls(self) -> DataFrame:
        return facts.of(self.facts, "calls")

    @cached_property
    def imports(self) -> DataFrame:
        return facts.imports(self.searched)

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(facts.resolved_imports(self.searched))

    @cached_property
    def identifiers(self) -> DataFrame:
        return cut(facts.identifier_index(self.searched))

    # --- searches ---

    def symbol(self, name: str, context: str | None = None, n: int | None = search.MATCHES) -> DataFrame:
        """Definitions and usages of a name, by stratum and relevance: the n first, all for None."""
        own = self.definitions.where((F.col("def_name") == name) | ((rules.file_type(F.col("path")) == "markdown") & T.whole_identifier(F.col("text"), name)))
        found = search.symbol_matches(search.distinct_definitions(own).withColumn("def_name", F.lit(name)), self.lines, name)
        return search.top(search.ranked(found, name, context=context), n)

    def symbol_totals(self, name: str) -> DataFrame:
        return search.totals(search.symbol_matches(self.definitions, self.lines, name))

    def content(self, q: str, n: int = search.MATCHES) -> DataFrame:
        """Lines with a literal; /pattern/ is a regular expression."""
        is_pattern = len(q) > 2 and q.startswith("/") and q.endswith("/")
        found = search.regex(self.lines, q[1:-1]) if is_pattern else search.literal(self.lines, q)
        return search.top(search.ranked(found, q), n)

    def concept(self, q: str, n: int = search.MATCHES) -> DataFrame:
        """The first that finds anything: definitions of the name, the phrase, its words, usages; see not_found for what none does."""
        if " " not in q and not self.definitions.where(F.lower("def_name") == q.lower()).isEmpty():
            return self.symbol(q, n=n)
        if search.exists(self.lines, q):
            return self.content(q, n)
        if " " in q:
            return search.top(search.ranked(search.relaxed(self.lines, q), q), n)
        return self.symbol(q, n=n)

    def not_found(self, q: str, n: int = 5) -> DataFrame:
        """Names like one that nothing was found for, nearest first."""
        return search.did_you_mean(self.definitions.select("def_name").distinct(), "def_name", q, 3, n)

    def callers(self, names: list[str], context: str | None = None) -> DataFrame:
        """Call sites of names, and of their callers."""
        targets = self.files.sparkSession.createDataFrame([(x,) for x in names], "name string")
        sites = graph.impact(self.calls, targets)
        return sites.orderBy("hop", F.when(F.col("path") == (context or ""), 0).otherwise(1), F.size(F.split("path", "/")), "path", "line", "callee")

    def _called(self, spans: DataFrame) -> DataFrame:
        """What the definitions spans (path, start_line, end_line, name) call, each resolved in its own file, then in imported files in order, then (Go) beside it: root_path, root_line, name, path, start_line, end_line, signature, sym_id."""
        r = spans.select(F.col("path").alias("root_path"), F.col("start_line").alias("root_line"), F.col("end_line").alias("_end")).distinct()
        inside = (F.col("path") == F.col("root_path")) & (F.col("line") >= F.col("root_line")) & (F.col("line") <= F.col("_end"))
        called = self.calls.join(r, inside).select("root_path", "root_line", F.col("callee").alias("name")).distinct()
        roots = r.select("root_path").distinct()
        s = self.symbols.where(F.col("depth") <= 1).select("path", "name", "start_line", "end_line", "signature", "sym_id")
        here = s.join(roots, F.col("path") == F.col("root_path")).withColumns({"prio": F.lit(0), "pos": F.lit(0)})
        imported = self.resolved.select(F.col("path").alias("root_path"), F.col("target").alias("path"), F.col("line").alias("pos")).join(roots, "root_path")
        there = s.join(imported, "path").withColumn("prio", F.lit(1))
        go = F.endswith(F.col("path"), F.lit(".go")) & F.endswith(F.col("root_path"), F.lit(".go"))
        beside = s.withColumn("_dir", T.dirname(F.col("path"))).join(roots.withColumn("_home", T.dirname(F.col("root_path"))), (F.col("_dir") == F.col("_home")) & (F.col("path") != F.col("root_path")) & go)
        beside = beside.drop("_dir", "_home").withColumns({"prio": F.lit(2), "pos": F.lit(0)})
        found = here.unionByName(there).unionByName(beside)
        nth = F.row_number().over(Window.partitionBy("root_path", "root_line", "name").orderBy("prio", "pos", "path", "sym_id"))
        return called.join(found, ["root_path", "name"]).withColumn("_nth", nth).where("_nth = 1").drop("_nth", "prio", "pos")

    def _own(self, path: str, name: str) -> DataFrame:
        """The first definition of a name in a file."""
        own = self.symbols.where((F.col("path") == path) & (F.col("name") == name)).select("path", "name", "start_line", "end_line")
        return own.orderBy("start_line").limit(1)

    def callees(self, path: str, name: str) -> DataFrame:
        """What a definition calls, resolved."""
        return self._called(self._own(path, name)).select("name", "path", "start_line", "end_line", "signature").orderBy("path", "start_line")

    def callees_two_hops(self, path: str, name: str, budget: int = 15) -> DataFrame:
        """What a definition calls (hop 1), and what those call (hop 2): hop, via, name, path, start_line, end_line.

        A definition is told by file and first line, and comes once, at its first hop; neither is the root its own
        callee.  Hop 2 ends at the budget, in order of the calling definitions and then of name.
        """
        own = self._own(path, name)
        first = cut(self._called(own).join(own.select("path", "start_line"), ["path", "start_line"], "left_anti"))
        one = first.select(F.lit(1).alias("hop"), F.lit(name).alias("via"), "name", "path", "start_line", "end_line")
        seen = first.select("path", "start_line").union(own.select("path", "start_line")).distinct()
        second = self._called(first.select("path", "start_line", "end_line")).join(seen, ["path", "start_line"], "left_anti")
        names = first.select(F.col("path").alias("root_path"), F.col("start_line").alias("root_line"), F.col("name").alias("via"))
        second = second.join(names, ["root_path", "root_line"])
        nth = F.row_number().over(Window.partitionBy("path", "start_line").orderBy("root_path", "root_line", "name"))
        second = second.withColumn("_nth", nth).where("_nth = 1").orderBy("root_path", "root_line", "name", "path").limit(budget)
        return one.union(second.select(F.lit(2).alias("hop"), "via", "name", "path", "start_line", "end_line")).orderBy("hop", "path", "start_line")

    def footer(self, path: str, name: str) -> DataFrame:
        """What is listed under a match of a definition: at most eight of those that it calls in two hops, itself left out."""
        called = self.callees_two_hops(path, name).where(F.col("name") != name)
        return graph.footer(called, path, [F.col("hop"), F.col("path"), F.col("start_line")])

    def unresolved(self, path: str, name: str, known: DataFrame | None = None) -> DataFrame:
        """Names that a definition calls and that resolve to none; known: its callees, if they are at hand."""
        own = self.symbols.where((F.col("path") == path) & (F.col("name") == name)).agg(F.min("start_line").alias("a"), F.min_by("end_line", "start_line").alias("b"))
        called = self.calls.where(F.col("path") == path).join(own, (F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b"))).select(F.col("callee").alias("name")).distinct()
        return called.join(self.callees(path, name) if known is None else known, "name", "left_anti").orderBy("name")

    def deps(self, path: str, parts: tuple[str, ...] = ("local", "external", "used_by")) -> dict[str, DataFrame]:
        """Local files that a file uses with the symbols it calls there, external imports, and who uses it; only the parts asked for are worked out."""
        makers = {"local": self._local, "external": self._external, "used_by": self._used_by}
        return {part: makers[part](path) for part in parts}

    def _local(self, path: str) -> DataFrame:
        called = self.calls.where(F.col("path") == path).select(F.col("callee").alias("name")).distinct()
        targets = self.resolved.where(F.col("path") == path).select("target").distinct()
        names = self.symbols.select(F.col("path").alias("target"), "name").distinct().join(called, "name")
        return targets.join(names, "target", "left").groupBy("target").agg(F.array_sort(F.collect_set("name")).alias("symbols")).orderBy("target")

    def _external(self, path: str) -> DataFrame:
        return self.imports.where((F.col("path") == path) & F.col("is_external") & ~F.col("is_stdlib") & rules.is_module_path(F.col("source"))).select("source").distinct().orderBy("source")

    def _used_by(self, path: str) -> DataFrame:
        exported = self.symbols.where((F.col("path") == path) & (F.col("depth") <= 1) & ~rules.is_placeholder(F.col("name")) & F.col("kind").isin("function", "class", "struct", "interface", "enum", "type")).select("name").distinct()
        used = graph.used_by(self.calls, exported, path)
        order = [F.when(T.dirname(F.col("path")) == T.dirname(F.lit(path)), 0).otherwise(1), F.when(T.is_test_path(F.col("path")), 1).otherwise(0), F.col("path"), F.col("line")]
        return used.orderBy(*order)

    def grok(self, name: str, full: bool = False) -> DataFrame:
        """A definition's bundle as tagged rows: target, callees, external, callers, tests, siblings; part, path, line, name, detail."""
        caps = FULL_CAPS if full else CAPS
        target = search.top(search.ranked(self.definitions.where(F.col("def_name") == name).withColumn("is_definition", F.lit(True)), name), 1).select("path", "line", F.lit(name).alias("name"), F.col("text").alias("detail")).first()
        spark = self.files.sparkSession
        if target is None:
            return spark.createDataFrame([], "part string, path string, line int, name string, detail string")
        path = target["path"]
        sites = graph.callers(self.calls, spark.createDataFrame([(name,)], "name string")).where(~F.col("caller").eqNullSafe(F.lit(name)))
        sites = sites.select("path", "line", F.col("caller").alias("name"), F.col("call_text").alias("detail"), T.is_test_path(F.col("path")).alias("t"))
        tag = lambda df, part, n: df.orderBy("path", "line", "name").limit(n).select(F.lit(part).alias("part"), "path", F.col("line").cast("int").alias("line"), "name", "detail")
        one = spark.createDataFrame([(path, target["line"], name, target["detail"])], "path string, line int, name string, detail string")
        called = cut(self.callees(path, name))
        callees = called.where(F.col("name") != name).select("path", F.col("start_line").alias("line"), "name", F.col("signature").alias("detail"))
        none = F.lit(None).cast("string")
        outside = self.unresolved(path, name, called).select(none.alias("path"), F.lit(None).cast("int").alias("line"), "name", none.alias("detail"))
        beside = graph.peers(self.symbols, path, name, caps["siblings"]).select("path", F.col("start_line").alias("line"), "name", F.col("signature").alias("detail"))
        out = tag(one, "target", 1)
        for df, part, n in ((callees, "callees", caps["callees"]), (outside, "external", caps["callees"]), (sites.where("NOT t"), "callers", caps["callers"]), (sites.where("t"), "tests", caps["tests"]), (beside, "siblings", caps["siblings"])):
            out = out.unionByName(tag(df, part, n))
        return out

    def member_siblings(self, path: str, name: str, n: int = 6) -> DataFrame:
        """Members of its type that a method refers to through self or this, functions first."""
        own = self.symbols.where((F.col("path") == path) & (F.col("name") == name)).select("parent_id", "start_line", "end_line").limit(1)
        used = facts.of(self.facts.where(F.col("path") == path), "members").join(own, (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))).select(F.col("name"), "parent_id").distinct()
        found = self.symbols.where(F.col("path") == path).join(used, ["name", "parent_id"]).where(F.col("name") != name)
        return found.orderBy(F.when(F.col("kind") == "function", 0).otherwise(1), "name").limit(n).select("name", "kind", "start_line", "signature")

    # --- views ---

    def outline(self, path: str) -> DataFrame:
        """Top level and one level of children in order; Markdown by headings, structured files by keys."""
        code = self.symbols.where((F.col("path") == path) & (F.col("depth") <= 1)).select("start_line", "end_line", "depth", "kind", "name", "signature")
        heads = self.sections.where(F.col("path") == path).select(F.col("line").alias("start_line"), "end_line", (F.col("level") - 1).alias("depth"), F.lit("heading").alias("kind"), F.col("heading").alias("name"), F.lit(None).cast("string").alias("signature"))
        return code.unionByName(heads).orderBy("start_line", "depth", "name")

    def read(self, path: str, first: int | None = None, last: int | None = None, heading: str | None = None) -> DataFrame:
        """Lines of a file, of a range, or of the section under a heading."""
        rows = self.lines.where(F.col("path") == path)
        if heading is not None:
            span = self.sections.where((F.col("path") == path) & (F.lower("heading") == heading.lstrip("# ").lower())).orderBy("line").limit(1).select(F.col("line").alias("a"), F.col("end_line").alias("b"))
            return rows.join(span, (F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b"))).select("path", "line", "text").orderBy("line")
        if first is not None:
            rows = rows.where((F.col("line") >= first) & (F.col("line") <= (last or first)))
        return rows.orderBy("line")

    def read_sections(self, wanted: list[tuple[str, int, int]], budget: int = 6_000) -> DataFrame:
        """Several ranges (path, first, last) as one answer: nth, path, first, last, text, shown.

        Ranges come in the order asked for while their texts fit the budget of tokens together; one that does
        not is replaced by a note, and later ones that do still come.
        """
        asked = self.files.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "nth int, path string, first int, last int")
        inside = (F.col("r.path") == F.col("a.path")) & (F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))
        got = asked.alias("a").join(self.lines.alias("r"), inside, "left").groupBy("nth", "a.path", "first", "last")
        got = got.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
        blocks = got.agg(F.array_sort(F.collect_list(F.struct("nth", "path", "first", "last", "text"))).alias("b"))  # as many as were asked for
        folded = pack.sections(F.transform("b", lambda x: F.struct(x["text"].alias("text"), T.token_estimate(x["text"]).alias("tokens"))), budget)
        out = blocks.select(F.explode(F.zip_with("b", folded, lambda x, t: F.struct(x["nth"].alias("nth"), x["path"].alias("path"), x["first"].alias("first"), x["last"].alias("last"), t.alias("text"), (x["text"] == t).alias("shown")))).alias("x"))
        return out.select("x.*").orderBy("nth")

    def at(self, path: str, line: int) -> DataFrame:
        """The innermost definition that holds a line."""
        found = self.symbols.where((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line) & F.col("kind").isin("function", "class", "struct", "interface", "enum", "module"))
        return found.orderBy(F.desc("start_line"), "end_line").limit(1)

    def body(self, path: str, name: str) -> DataFrame:
        """The lines of a definition, and whether it only wraps one other: at most ten lines that call one known definition and nothing else."""
        own = self._own(path, name)
        inside = (F.col("l.path") == F.col("o.path")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
        called = cut(self.callees(path, name))
        known, unknown = called.where(F.col("name") != name), self.unresolved(path, name, called)
        counts = known.agg(F.count("*").alias("known")).join(unknown.agg(F.count("*").alias("unknown")), how="cross")  # one row each
        rows = self.lines.alias("l").join(own.alias("o"), inside).join(counts, how="cross")
        wraps = (F.col("end_line") - F.col("start_line") < 10) & (F.col("known") == 1) & (F.col("unknown") == 0)
        return rows.select("l.path", "line", "text", wraps.alias("wraps")).orderBy("line")

    def modes(self) -> DataFrame:
        """How each file would be shown."""
        outline = self.symbols.where("depth <= 1").groupBy("path").agg(F.sum(T.token_estimate(F.col("signature"))).alias("o"))
        f = self.files.join(outline, "path", "left")
        mode = rules.view_mode(F.octet_length("text"), F.col("text"), F.col("path"), rules.is_binary(F.encode("text", "UTF-8")), F.lit(False), F.coalesce("o", F.lit(0)))
        return f.select("path", mode.alias("mode"), T.token_estimate(F.col("text")).alias("tokens")).orderBy("path")

    def map(self, depth: int = 3) -> DataFrame:
        """Directories with their tokens, and files with theirs and their top-level symbols; deepest ones summed up."""
        f = self.files.select("path", T.token_estimate(F.col("text")).alias("tokens"))
        dirs = rollup.directory_totals(f, "tokens").select(F.concat("dir", F.lit("/")).alias("path"), F.col("total").alias("tokens"), F.lit(None).cast("array<string>").alias("symbols"))
        named = self.symbols.where("depth = 0 AND kind NOT IN ('import', 'variable')").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("s"))
        own = f.where(F.size(F.split("path", "/")) <= depth).join(named, "path", "left").select("path", "tokens", F.transform("s", lambda x: x["name"]).alias("symbols"))
        return dirs.where(F.size(F.split("path", "/")) - 1 <= depth).union(own).orderBy("path")

    def fingerprint(self) -> dict[str, DataFrame]:
        """Languages, modules, manifests, most imported files and marks of a test style."""
        f = self.files.withColumn("lang", rules.language(F.col("path")))
        hot = self.resolved.select("path", "target", F.col("source").alias("symbol"))
        marks = {"pytest": "def test_", "unittest": "unittest.TestCase", "jest": "describe(", "rust": "#[test]", "go": "func Test", "junit": "@Test"}
        style = self.searched.agg(*[F.coalesce(F.bool_or(F.contains("text", F.lit(m))), F.lit(False)).alias(k) for k, m in marks.items()])
        return {"languages": rollup.histogram(f, "lang"), "modules": rollup.module_names(f), "manifests": documents.manifests(self.files), "hot": graph.hot_targets(hot), "tests": style}

    # --- changes ---

    def versions(self, side: str) -> DataFrame:
        return self.symbols.where("kind NOT IN ('import', 'export')").select(F.lit(side).alias("side"), "path", "kind", "parent_path", "name", "start_line", "end_line", "signature", "content_hash", "structural_hash", "source_text")

    def changed_since(self, old: CodeBase) -> DataFrame:
        """Symbol changes from another state of the tree, moves included."""
        found = cut(diff.match_versions(old.versions("old").drop("end_line").unionByName(self.versions("new").drop("end_line"))))
        return diff.moves(found.where("change <> 'unchanged'")).orderBy("path", F.coalesce("new_line", "old_line"), "name", "change")

    def blast(self, edited: DataFrame) -> DataFrame:
        """Callers of the functions whose signatures edited ranges (path, start, end) touch."""
        spans = self.symbols.where("kind = 'function'").select("path", "name", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        touched = graph.overlapping(edited, spans, "path").select("name").distinct()
        return graph.blast(self.calls, touched, T.is_test_path(F.col("path"))).orderBy("callee")

    def apply(self, edits: DataFrame) -> DataFrame:
        """path, text of the edited files: edits (path, start, end, start_hash, content) whose anchors hold and that don't overlap; nothing is written."""
        checked = diff.verified(edits.withColumn("new_lines", F.size(F.split("content", "\n"))), self.lines)
        checked = diff.edit_offsets(checked, ["path"])
        bad = checked.where(~F.col("ok") | F.col("overlaps")).select("path").distinct()
        good = checked.join(bad, "path", "left_anti").select(F.col("path").alias("_path"), F.col("start").alias("_a"), F.col("end").alias("_b"), "content")
        rows = self.lines.join(good.select(F.col("_path").alias("path")).distinct(), "path", "left_semi")
        on = (F.col("path") == F.col("_path")) & (F.col("line") >= F.col("_a")) & (F.col("line") <= F.col("_b"))
        new = rows.join(good, on, "left").withColumn("out", F.when(F.col("_a").isNull(), F.col("text")).when(F.col("line") == F.col("_a"), F.col("content")))
        ordered = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("line", "out"))))
        return new.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "\n").alias("text"))

    # --- packing ---

    def within(self, matches: DataFrame, budget: int) -> DataFrame:
        """Matches that fit a token budget, by score."""
        items = matches.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stratum", F.desc("score"), "path", "line"))).select(F.lit(0).alias("q"), "idx", F.col("score").alias("value"), T.token_estimate(F.col("text")).alias("tokens"))
        return pack.packed(items, ["q"], budget).drop("q")
