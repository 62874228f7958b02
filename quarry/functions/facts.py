"""Facts of source files: symbols, definitions, calls, imports, identifiers, member references, structural hashes.

Python is parsed by its own grammar.  Languages with braces are read by a lexer that drops
comments and strings and keeps a stack of open blocks; the others by line patterns.  A file
that can't be read gives what its lines give, never an error.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

MOST_BYTES = 500_000


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    signature: str
    doc: str | None = None
    children: list[Symbol] = field(default_factory=list)


@dataclass
class Facts:
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[tuple[int, str]] = field(default_factory=list)  # line, callee
    members: list[tuple[int, str]] = field(default_factory=list)


#: What ends a definition's head, the first that a line has: a block, a colon, do.
HEAD_ENDS = tuple(re.compile(p) for p in (r"\s*\{.*$", r"\s*:$", r"\s* do$", r"\s*, do:.*$"))
HEAD_BYTES = 120


def signature(line: str) -> str:
    """A definition's first line up to its block; without one at most HEAD_BYTES."""
    head = line.strip()
    if end := next((m for p in HEAD_ENDS if (m := p.search(head))), None):
        return head[: end.start()]
    if len(head.encode()) > HEAD_BYTES:
        return head.encode()[: HEAD_BYTES - 3].decode("utf-8", "ignore") + "..."
    return head


# --- Python -------------------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, lines: list[str]):
        self.lines, self.facts, self.stack = lines, Facts(), []

    def _define(self, node: ast.AST, kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        doc = ast.get_docstring(node)
        symbol = Symbol(kind, node.name, first, node.end_lineno or node.lineno, signature(self.lines[node.lineno - 1]), doc.split("\n")[0].strip() if doc else None)
        (self.stack[-1].children if self.stack else self.facts.symbols).append(symbol)
        self.stack.append(symbol)
        self.generic_visit(node)
        self.stack.pop()

    def visit_FunctionDef(self, node):  # noqa: N802
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node):  # noqa: N802
        self._define(node, "class")

    def visit_Assign(self, node):  # noqa: N802
        if not self.stack or self.stack[-1].kind == "class":
            for target in node.targets:
                if isinstance(target, ast.Name):
                    kind = "constant" if target.id.isupper() else "variable"
                    (self.stack[-1].children if self.stack else self.facts.symbols).append(Symbol(kind, target.id, node.lineno, node.end_lineno, self.lines[node.lineno - 1].strip()[:120]))
        self.generic_visit(node)

    def visit_Call(self, node):  # noqa: N802
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.facts.calls.append((node.func.end_lineno or node.lineno, name))
        self.generic_visit(node)

    def visit_Attribute(self, node):  # noqa: N802
        if isinstance(node.value, ast.Name) and node.value.id in ("self", "cls"):
            self.facts.members.append((node.lineno, node.attr))
        self.generic_visit(node)


def python_facts(text: str) -> Facts | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    visitor = _Python(text.split("\n"))
    visitor.visit(tree)
    return visitor.facts


# --- lexer --------------------------------------------------------------------------------

TOKEN = {
    "slash": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])'|'[A-Za-z_]\w*(?!')|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|::|->|=>|[^\s\w]", re.S),
    "hash": re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[^\W\d][\w]*[?!]?|\d[\w.]*|::|->|=>|[^\s\w]", re.S),
}
HASH_LANGUAGES = ("python", "ruby", "elixir", "bash", "make", "dockerfile")


def tokens(text: str, lang: str | None) -> Iterator[tuple[int, str]]:
    """(line, token) without comments; strings are left out, and so are Rust lifetimes."""
    line, at = 1, 0
    for m in TOKEN["hash" if lang in HASH_LANGUAGES else "slash"].finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        t = m[0]
        if t[0] in "\"'`" or t.startswith(("//", "/*")) or (t[0] == "#" and len(t) > 1):
            continue
        yield line, t


def identifiers(text: str, lang: str | None) -> set[str]:
    return {t for _, t in tokens(text, lang) if t[0].isalpha() or t[0] == "_"}


def structural_hash(text: str, name: str, lang: str | None) -> str:
    """Digest of the tokens, without comments and the name's first occurrence."""
    out, seen = hashlib.sha1(), False
    for _, t in tokens(text, lang):
        if t == name and not seen:
            seen = True
            continue
        out.update(t.encode() + b"\0")
    return out.hexdigest()


# --- languages with braces ----------------------------------------------------------------

NAME = r"([A-Za-z_$][\w$]*)"
MODS = r"(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|static|final|abstract|async|const|unsafe|extern|override|open|suspend|inline|virtual|sealed|data|partial|readonly|declare|case|implicit|lazy)\s+)*"
RULES: dict[str, list[tuple[str, re.Pattern]]] = {
    lang: [(kind, re.compile(r"^\s*" + MODS + pattern)) for kind, pattern in own]
    for lang, own in {
        "rust": [("function", rf"fn\s+{NAME}"), ("struct", rf"struct\s+{NAME}"), ("enum", rf"enum\s+{NAME}"), ("interface", rf"trait\s+{NAME}"), ("impl", r"impl(?:<[^{]*?>)?\s+([^{]+?)\s*(?:where\b.*)?\{?\s*$"), ("module", rf"mod\s+{NAME}"), ("type", rf"type\s+{NAME}"), ("constant", rf"(?:const|static)\s+(?:mut\s+)?{NAME}\s*:"), ("function", rf"macro_rules!\s+{NAME}")],
        "go": [("function", rf"func\s+(?:\([^)]*\)\s*)?{NAME}"), ("struct", rf"type\s+{NAME}\s+struct\b"), ("interface", rf"type\s+{NAME}\s+interface\b"), ("type", rf"type\s+{NAME}\b"), ("constant", rf"const\s+{NAME}"), ("variable", rf"var\s+{NAME}")],
        "javascript": [("function", rf"function\s*\*?\s*{NAME}"), ("class", rf"class\s+{NAME}"), ("interface", rf"interface\s+{NAME}"), ("interface", rf"type\s+{NAME}\s*(?:<[^=]*>)?\s*="), ("enum", rf"enum\s+{NAME}"), ("module", rf"(?:namespace|module)\s+{NAME}"), ("variable", rf"(?:let|var)\s+{NAME}"), ("variable", rf"{NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)")],
        "java": [("class", rf"(?:class|record)\s+{NAME}"), ("interface", rf"@?interface\s+{NAME}"), ("enum", rf"enum\s+{NAME}"), ("struct", rf"struct\s+{NAME}"), ("module", rf"namespace\s+([\w.]+)"), ("function", rf"(?:<[^>]*>\s*)?[\w.<>\[\],?]+\s+{NAME}\s*\([^;]*$")],
        "kotlin": [("function", rf"fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?{NAME}"), ("class", rf"(?:class|enum\s+class|annotation\s+class)\s+{NAME}"), ("interface", rf"(?:interface|trait)\s+{NAME}"), ("module", rf"object\s+{NAME}"), ("function", rf"def\s+{NAME}"), ("immutable", rf"val\s+{NAME}"), ("variable", rf"var\s+{NAME}"), ("type", rf"(?:typealias|type)\s+{NAME}")],
        "c": [("struct", rf"(?:typedef\s+)?(?:struct|union)\s+{NAME}\s*\{{?"), ("enum", rf"(?:typedef\s+)?enum\s+(?:class\s+)?{NAME}"), ("class", rf"class\s+{NAME}"), ("module", rf"namespace\s+{NAME}"), ("function", rf"(?:template\s*<[^>]*>\s*)?[\w:<>,*&~ ]+?[\s*&]{NAME}(?:::{NAME[1:-1]})?\s*\([^;]*$")],
        "swift": [("function", rf"func\s+{NAME}"), ("class", rf"(?:class|actor)\s+{NAME}"), ("struct", rf"struct\s+{NAME}"), ("enum", rf"enum\s+{NAME}"), ("interface", rf"protocol\s+{NAME}"), ("module", rf"extension\s+{NAME}"), ("function", r"(init|deinit)\b"), ("immutable", rf"let\s+{NAME}"), ("variable", rf"var\s+{NAME}")],
        "php": [("function", rf"function\s+&?{NAME}"), ("class", rf"class\s+{NAME}"), ("interface", rf"(?:interface|trait)\s+{NAME}"), ("enum", rf"enum\s+{NAME}"), ("module", r"namespace\s+([\w\\]+)"), ("constant", rf"const\s+{NAME}")],
        "bash": [("function", rf"(?:function\s+)?{NAME}\s*\(\)"), ("function", rf"function\s+{NAME}"), ("variable", rf"(?:export\s+|local\s+|readonly\s+|declare\s+(?:-\w+\s+)?)?{NAME}=")],
    }.items()
}
METHOD = re.compile(rf"^\s*{MODS}(?:get\s+|set\s+|\*\s*|#)?{NAME}\s*\([^;]*\)\s*(?::[^={{]*)?\{{")
CONST_FUNCTION = re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?const\s+{NAME}")
ALIASES = {"typescript": "javascript", "tsx": "javascript", "scala": "kotlin", "cpp": "c", "csharp": "java"}
#: Words that a parenthesis follows without a call.
NOT_CALLS = {
    "if", "for", "while", "switch", "match", "return", "catch", "fn", "func", "function", "def", "class", "struct", "enum", "impl", "trait", "sizeof",
    "typeof", "new", "await", "async", "let", "const", "var", "use", "import", "export", "in", "of", "do", "else", "elif", "with", "assert", "raise",
    "yield", "throw", "try", "loop", "where", "and", "or", "not", "lambda", "unless", "until", "when", "case",
}
GO_WORDS = {"go", "defer", "select", "range"}
NESTING = ("class", "struct", "module", "interface", "impl", "enum")


MASKS = {
    # ' delimits strings in these languages, single characters (or lifetimes) in the others
    True: re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.S),
    False: re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`?", re.S),
}


def _masked(text: str, lang: str) -> str:
    """The text with comments and strings blanked, line by line of the same length."""
    return MASKS[lang in ("javascript", "typescript", "tsx", "php", "bash")].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_facts(text: str, lang: str) -> Facts:
    own = ALIASES.get(lang, lang)
    patterns, facts = RULES.get(own, []), Facts()
    no_calls = NOT_CALLS | GO_WORDS if lang == "go" else NOT_CALLS
    raw, lines = text.split("\n"), _masked(text, lang).split("\n")
    stack: list[tuple[Symbol | None, int]] = []  # open symbol, brace depth outside of it
    depth, pending = 0, None
    for number, line in enumerate(lines, 1):
        inside = next((s for s, _ in reversed(stack) if s), None)
        found = None
        if inside is None or inside.kind in NESTING or lang in ("rust", "go"):
            for kind, p in patterns:
                if (m := p.match(line)) and m[1] not in no_calls:
                    found = Symbol(kind, m[1].strip(), number, number, signature(raw[number - 1]))
                    break
            if not found and own == "javascript":
                if inside and inside.kind == "class" and (m := METHOD.match(line)) and m[1] not in no_calls:
                    found = Symbol("function", m[1], number, number, signature(raw[number - 1]))
                elif not inside and (m := CONST_FUNCTION.match(line)):
                    found = Symbol("constant", m[1], number, number, signature(raw[number - 1]))
            if found and found.kind == "impl":
                found.kind, found.name = "module", f"impl {found.name}"
        if found:
            above = [r.strip() for r in raw[max(0, number - 2) : number - 1]]
            if above and above[0].startswith(("///", "//", "/*", "*", "#")) and not above[0].startswith("#["):
                found.doc = above[0]
            (inside.children if inside else facts.symbols).append(found)
            pending = found
        for m in re.finditer(r"[{}]", line):
            if m[0] == "{":
                stack.append((pending, depth))
                pending, depth = None, depth + 1
            elif stack:
                closed, depth = stack.pop()
                if closed:
                    closed.end = number
        if pending and line.rstrip().endswith(";"):
            pending = None
        for m in re.finditer(r"([A-Za-z_$][\w$]*)(!?)\s*(?:::<[^>]*>)?\(", line):
            if m[1] not in no_calls and not (found and m[1] == found.name and found.kind == "function"):
                facts.calls.append((number, m[1]))
        facts.members += [(number, m[1]) for m in re.finditer(r"\b(?:self|this)\s*(?:\.|->)\s*([A-Za-z_]\w*)", line)]
    for open_symbol, _ in stack:
        if open_symbol:
            open_symbol.end = len(lines)
    return facts


# --- languages with end -------------------------------------------------------------------

END_RULES = {
    "ruby": [("function", re.compile(r"^(\s*)def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)")), ("class", re.compile(r"^(\s*)class\s+([A-Z]\w*)")), ("module", re.compile(r"^(\s*)module\s+([A-Z]\w*)"))],
    "elixir": [("function", re.compile(r"^(\s*)defp?\s+([a-z_]\w*[?!]?)")), ("function", re.compile(r"^(\s*)defmacrop?\s+([a-z_]\w*)")), ("module", re.compile(r"^(\s*)defmodule\s+([A-Z][\w.]*)")), ("interface", re.compile(r"^(\s*)defprotocol\s+([A-Z][\w.]*)"))],
}


def end_facts(text: str, lang: str) -> Facts:
    """Blocks close at an end (or a line without deeper indent) of their own indent."""
    facts, stack = Facts(), []
    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        plain = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", " ", line).partition("#")[0]
        if stack and re.match(rf"^\s{{0,{stack[-1][1]}}}end\b", plain):
            stack.pop()[0].end = number
        for kind, p in END_RULES[lang]:
            if m := p.match(plain):
                symbol = Symbol(kind, m[2], number, number, signature(line))
                (stack[-1][0].children if stack else facts.symbols).append(symbol)
                if not re.search(r",\s*do:", plain):
                    stack.append((symbol, len(m[1])))
                break
        else:
            facts.calls += [(number, m[1]) for m in re.finditer(r"\b([a-z_]\w*[?!]?)\s*\(", plain) if m[1] not in NOT_CALLS]
        facts.members += [(number, m[1]) for m in re.finditer(r"\bself\.([a-z_]\w*)", plain)]
    return facts


def facts_of(text: str, lang: str | None) -> Facts:
    if lang == "python":
        found = python_facts(text)
        if found is not None:
            return found
    if lang in END_RULES:
        return end_facts(text, lang)
    if ALIASES.get(lang or "", lang) in RULES:
        return brace_facts(text, lang)
    keyword = re.compile(r"^\s*(?:" + "|".join(re.escape(d) for d in rules.DEFINES) + r")\s*([A-Za-z_]\w*)")
    return Facts([Symbol("function", m[1], n, n, signature(line)) for n, line in enumerate(text.split("\n"), 1) if (m := keyword.match(line))])


def flat(symbols: list[Symbol]) -> Iterator[tuple[int, int | None, int, str, Symbol]]:
    """(id, parent id, depth, parent path, symbol), in order of the file."""
    queue = [(s, None, 0, "") for s in symbols]
    n = 0
    while queue:
        s, parent, depth, path = queue.pop(0)
        yield n, parent, depth, path, s
        queue[:0] = [(c, n, depth + 1, f"{path}{s.name}.") for c in s.children]
        n += 1


def enclosing(symbols: list[Symbol], line: int) -> tuple[str, int, int] | None:
    """Innermost function or type that holds a line; functions within types and modules are qualified."""
    best, names, level = None, [], symbols
    while level:
        s = next((s for s in reversed(level) if s.start <= line <= s.end and s.kind in (*NESTING, "function")), None)
        if s is None:
            break
        qualifier = [n for n, k in names if k in ("class", "struct", "module", "interface") and not n.startswith("impl ")]
        best = (".".join([*qualifier[-1:], s.name]), s.start, s.end)
        names.append((s.name, s.kind))
        level = s.children
    return best


# --- tables -------------------------------------------------------------------------------

#: What a scan can find in a file, each an array of structs.
FOUND = {
    "symbols": "sym_id int, parent_id int, depth int, kind string, name string, parent_path string, start_line int, end_line int, signature string, doc string, content_hash string, structural_hash string, source_text string",
    "calls": "line int, callee string, caller string, call_text string, caller_start int, caller_end int",
    "members": "line int, name string",
    "identifiers": "name string",
    "tests": "line int, depth int, kind string, name string",
    "errors": "line int, kind string, detail string",
}
#: Those that need the symbols of a file.
PARSED = {"symbols", "calls", "members"}


def _symbols(text: str, lang: str, found: Facts) -> Iterator[tuple]:
    lines = text.split("\n")
    for n, parent, depth, parent_path, s in flat(found.symbols):
        body = "\n".join(lines[s.start - 1 : s.end])
        yield n, parent, depth, s.kind, s.name, parent_path, s.start, s.end, s.signature, s.doc, hashlib.sha1(body.encode()).hexdigest(), structural_hash(body, s.name, lang), body


def _calls(text: str, lang: str, found: Facts) -> Iterator[tuple]:
    lines = text.split("\n")
    for line, callee in found.calls:
        caller = enclosing(found.symbols, line) or (None, None, None)
        yield line, callee, caller[0], lines[line - 1].strip(), *caller[1:]


MAKERS = {
    "symbols": _symbols, "calls": _calls, "members": lambda text, lang, found: iter(found.members),
    "identifiers": lambda text, lang, found: ((n,) for n in sorted(identifiers(text, lang))),
    "tests": lambda text, lang, found: iter(test_outline(text) if lang in ("javascript", "typescript", "tsx") else ()),
    "errors": lambda text, lang, found: iter(parse_errors(text, lang)),
}


def scan(files: DataFrame, kinds: tuple[str, ...] = ("symbols", "calls", "members")) -> DataFrame:
    """path, and an array for each kind: each file (path, text) of at most MOST_BYTES is parsed once."""
    fields = {k: [c.split()[0] for c in FOUND[k].split(", ")] for k in kinds}
    types = {k: pa.list_(pa.struct([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in FOUND[k].split(", ")])) for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = facts_of(text, lang) if PARSED & {*kinds} else Facts()
                for k in kinds:
                    out[k].append([dict(zip(fields[k], row, strict=True)) for row in MAKERS[k](text, lang, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], types[k]) for k in kinds)], ["path", *kinds])

    rows = files.where(F.octet_length("text") <= MOST_BYTES).select("path", "text", rules.language(F.col("path")).alias("lang")).where("lang IS NOT NULL")
    schema = ", ".join(["path string", *(f"{k} array<struct<{', '.join(': '.join(c.split()) for c in FOUND[k].split(', '))}>>" for k in kinds)])
    return rows.mapInArrow(run, schema)


def of(scanned: DataFrame, kind: str) -> DataFrame:
    """path and the columns of one kind, a row for each fact."""
    return scanned.select("path", F.explode(kind).alias("_x")).select("path", "_x.*")


def symbols(files: DataFrame) -> DataFrame:
    return of(scan(files, ("symbols",)), "symbols")


WEIGHTS = {"function": 100, "class": 100, "struct": 100, "interface": 100, "enum": 100, "type": 100, "constant": 80, "module": 70, "property": 70, "variable": 40, "immutable": 40}


def definitions(files: DataFrame) -> DataFrame:
    return definitions_of(symbols(files))


def definitions_of(found: DataFrame) -> DataFrame:
    """path, line, text, def_name, def_weight, start_line, end_line, impl_target of symbols down to the third level; an impl names its type."""
    s = found.where("depth <= 2")
    impl = F.regexp_extract("name", r"^impl\s+(?:.*\bfor\s+)?([A-Za-z_]\w*)", 1)
    is_impl = F.startswith("name", F.lit("impl "))
    bash = rules.language(F.col("path")) == "bash"
    weight = F.when(is_impl, 90).when(bash & (F.col("kind") == "variable"), 60)
    for kind, w in WEIGHTS.items():
        weight = weight.when(F.col("kind") == kind, w)
    name = F.when(is_impl, impl).otherwise(F.col("name"))
    text = F.substring_index("source_text", "\n", 1)
    return s.select("path", F.col("start_line").alias("line"), text.alias("text"), name.alias("def_name"), weight.otherwise(50).alias("def_weight"), "start_line", "end_line", F.when(is_impl, impl).alias("impl_target"))


def calls(files: DataFrame) -> DataFrame:
    return of(scan(files, ("calls",)), "calls")


def members(files: DataFrame) -> DataFrame:
    return of(scan(files, ("members",)), "members")


def tests(files: DataFrame) -> DataFrame:
    """Suites and tests of JavaScript and TypeScript files by nesting: path, line, depth, kind, name."""
    return of(scan(files, ("tests",)), "tests")


def errors(files: DataFrame) -> DataFrame:
    """path, line, kind, detail of what does not parse, see parse_errors; for diff.new_errors."""
    return of(scan(files, ("errors",)), "errors")


def identifier_index(files: DataFrame) -> DataFrame:
    """An exact inverted index in place of a filter for each file: semi-join names against it."""
    return of(scan(files, ("identifiers",)), "identifiers")


def imports(files: DataFrame) -> DataFrame:
    """Import lines with their source; external and stdlib by rule."""
    lang, text = rules.language(F.col("path")), F.regexp_replace("text", "\r", "")
    each = files.where((F.octet_length("text") <= MOST_BYTES) & lang.isNotNull()).select("path", lang.alias("lang"), F.posexplode(F.split(text, "\n")).alias("nth", "source"))
    each = each.where(rules.is_import_line(F.col("source"), F.col("lang")))
    out = each.select("path", (F.col("nth") + 1).alias("line"), rules.import_source(F.col("source"), F.col("lang")).alias("source"), "lang").where("source <> ''")
    return out.withColumn("is_external", rules.is_external(F.col("source"), F.col("lang"))).withColumn("is_stdlib", rules.is_stdlib(F.col("source"), F.col("lang")))


def candidates(path: str, source: str, lang: str) -> list[str]:
    """Files that an import may mean, in order of preference; paths are relative to the tree."""
    home = path.rpartition("/")[0]

    def at(base: str, rel: str) -> str:
        parts: list[str] = []
        for p in f"{base}/{rel}".split("/"):
            if p == ".." and parts:
                parts.pop()
            elif p not in ("", ".", ".."):
                parts.append(p)
        return "/".join(parts)

    if lang == "rust":
        head, _, rest = source.partition("::")
        up = home.split("/")
        base = {"crate": "/".join(up[: len(up) - up[::-1].index("src")]) if "src" in up else None, "self": home, "super": home.rpartition("/")[0]}.get(head)
        if base is None:
            return []
        parts = rest.split("::")
        return [at(base, "/".join(parts[:n]) + end) for n in range(len(parts), 0, -1) for end in (".rs", "/mod.rs")]
    if lang in ("javascript", "typescript", "tsx"):
        base = at(home, source)
        return [base + e for e in (".ts", ".tsx", ".js", ".jsx")] + [base] + [f"{base}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx")]
    if lang == "python":
        dots = len(source) - len(source.lstrip("."))
        if not dots:
            return []
        base, rel = at(home, "../" * (dots - 1)), source[dots:].replace(".", "/")
        return [at(base, rel + ".py"), at(base, rel + "/__init__.py")] if rel else [at(base, "__init__.py")]
    return [at(home, source.strip('"'))] if lang in ("c", "cpp", "bash") else []


def resolved_imports(files: DataFrame, most: int = 8) -> DataFrame:
    """path, line, source, target: local imports joined to the first file that exists; the most first targets of each file."""
    from pyspark.sql import Window

    local = imports(files).where("NOT is_external")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(p, n, s, c, k) for p, n, s, x in zip(frame["path"], frame["line"], frame["source"], frame["lang"], strict=True) for k, c in enumerate(candidates(p, s, x))]
            yield pd.DataFrame(out, columns=["path", "line", "source", "target", "pos"]).astype({"line": "int32", "pos": "int32"})

    each = local.mapInPandas(run, "path string, line int, source string, target string, pos int")
    there = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    best = there.groupBy("path", "line", "source").agg(F.min_by("target", "pos").alias("target")).where("target <> path")
    first = best.groupBy("path", "target").agg(F.min("line").alias("line"), F.min_by("source", "line").alias("source"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line", "target"))
    return first.withColumn("_nth", nth).where(F.col("_nth") <= most).select("path", "line", "source", "target")


def parse_errors(text: str, lang: str | None) -> list[tuple[int, str, str]]:
    """(line, kind, detail): Python by its grammar, others by the balance of brackets."""
    if lang == "python":
        try:
            ast.parse(text)
        except SyntaxError as e:
            return [(e.lineno or 1, "error", (e.text or "").strip()[:40])]
        except (ValueError, RecursionError):
            return [(1, "error", "")]
        return []
    pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], []
    for line, t in tokens(text, lang):
        if t in "([{":
            stack.append((line, t))
        elif t in pairs:
            if stack and stack[-1][1] == pairs[t]:
                stack.pop()
            else:
                out.append((line, "error", t))
    return out + [(line, "missing", {"(": ")", "[": "]", "{": "}"}[t]) for line, t in stack]


def test_outline(text: str) -> list[tuple[int, int, str, str]]:
    """(line, depth, suite or test, name) of describe, context, it, test and specify calls."""
    out, depth, opens = [], 0, []
    for number, (line, plain) in enumerate(zip(text.split("\n"), _masked(text, "javascript").split("\n"), strict=True), 1):
        if m := re.match(r"^\s*(describe|context|it|test|specify)(?:\.\w+)*\s*\(\s*(['\"`])(.*?)\2", line):
            kind = "suite" if m[1] in ("describe", "context") else "test"
            out.append((number, len(opens), kind, m[3]))
            if kind == "suite":
                opens.append(depth)
        depth += plain.count("{") - plain.count("}")
        while opens and depth <= opens[-1] and "}" in plain:
            opens.pop()
    return out
