"""Classification rules as columns: file types, queries, imports, noise and importance of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Language by extension and by file name.
LANGUAGES = {
    "typescript": ("ts",), "tsx": ("tsx",), "javascript": ("js", "jsx"), "python": ("py", "pyi"), "rust": ("rs",), "go": ("go",),
    "java": ("java",), "scala": ("scala", "sc"), "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc", "cxx"), "ruby": ("rb",), "php": ("php", "phtml"),
    "swift": ("swift",), "kotlin": ("kt", "kts"), "csharp": ("cs",), "elixir": ("ex", "exs"), "bash": ("sh", "bash", "bats"),
}
NAMED = {"dockerfile": ("Dockerfile", "Containerfile"), "make": ("Makefile", "GNUmakefile"), "ruby": ("Vagrantfile", "Rakefile"), "bash": (".bashrc", ".bash_profile", ".bash_aliases", ".profile")}
KINDS = {"markdown": ("md", "mdx", "rst"), "structured": ("json", "yaml", "yml", "toml", "xml", "ini"), "tabular": ("csv", "tsv"), "log": ("log",)}
# Files that tools write.
GENERATED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "go.sum", "bun.lockb")
GENERATED_MARKS = (
    "@generated", "DO NOT EDIT", "Do not edit", "do not edit", "auto-generated", "Auto-generated", "AUTO-GENERATED", "this file is generated",
    "This file is generated", "THIS FILE IS GENERATED", "automatically generated", "Automatically generated",
)
# File names without an extension.
BARE_NAMES = (
    "README", "LICENSE", "Makefile", "GNUmakefile", "Dockerfile", "Containerfile", "Vagrantfile", "Rakefile", "Gemfile", "Procfile", "Justfile",
    "Taskfile", "CHANGELOG", "CONTRIBUTING", "AUTHORS", "CODEOWNERS",
)
# How a line that defines something begins.
DEFINES = (
    "fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "function ", "export function ", "export default function ", "export async function ",
    "async function ", "const ", "export const ", "let ", "export let ", "var ", "export var ", "class ", "export class ", "interface ", "export interface ",
    "type ", "export type ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "impl ", "def ", "async def ", "func ",
)
# Calls that only log, by family of languages.
FAMILIES = {
    "rust": ("rust",), "python": ("python",), "go": ("go",), "js": ("javascript", "typescript", "tsx"), "jvm": ("java", "kotlin", "csharp", "scala"),
    "c": ("c", "cpp"), "bash": ("bash",),
}
DEBUG_LOGS = {
    "rust": ("log::debug!", "log::trace!", "tracing::debug!", "tracing::trace!", "debug!(", "trace!(", "dbg!("),
    "python": ("logger.debug(", "logging.debug(", "print(", "pprint(", "pprint.pprint("),
    "go": ("log.Printf(", "log.Println(", "log.Print(", "fmt.Printf(", "fmt.Println(", "fmt.Print("),
    "js": ("console.log(", "console.debug(", "console.trace("),
    "jvm": ("System.out.print", "logger.debug(", "log.debug(", "Log.d(", "println("),
    "c": ("printf(", "std::cout", "cout ", "cout<<"),
    "bash": ('echo "DEBUG', "echo 'DEBUG"),
}
COMMENTS = {"rust": "//", "python": "#", "go": "//", "js": "//", "jvm": "//", "c": "//", "bash": "#"}
DOC_COMMENTS = {
    "rust": ("///", "//!", "/**", "#[doc"), "python": ('"""', "'''"), "go": (), "js": ("/**", "* "), "jvm": ("/**", "///"),
    "c": ("/**", "///", "//!"), "bash": ("#!",),
}
KEEP_MARKS = ("TODO", "FIXME", "NOTE", "HACK", "SAFETY", "WARN")
# Standard libraries.
GO_STDLIB = (
    "archive", "bufio", "bytes", "cmp", "compress", "container", "context", "crypto", "database", "debug", "embed", "encoding", "errors", "flag",
    "fmt", "go", "hash", "html", "image", "index", "io", "log", "maps", "math", "mime", "net", "os", "path", "plugin", "reflect", "regexp", "runtime",
    "slices", "sort", "strconv", "strings", "sync", "syscall", "testing", "text", "time", "unicode", "unsafe", "iter", "unique",
)
PYTHON_STDLIB = (
    "os", "sys", "re", "json", "math", "time", "datetime", "pathlib", "typing", "collections", "functools", "itertools", "abc", "io", "logging",
    "unittest", "dataclasses", "enum", "copy", "hashlib", "subprocess", "threading", "asyncio",
)
# What marks a line as a comment, as control flow, as handling of errors, as an assignment.
COMMENT_STARTS, COMMENT_ENDS = ("//", "#", "/*", "* "), ("*/", "*")
FLOW_STARTS = ("if ", "} else", "else ", "else{", "match ", "switch ", "case ", "for ", "while ", "loop ", "loop{", "return ", "return;")
FLOW_WORDS = ("else", "loop", "return")
ERROR_MARKS, ERROR_STARTS = (".unwrap()", ".expect(", "panic!(", "bail!(", "anyhow!("), ("catch ", "catch(", "except ", "except:")
ASSIGN_STARTS = ("let ", "const ", "var ", "mut ")


def starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes], F.lit(False))


def language(path: Column) -> Column:
    """Language of a code file, or null."""
    ext, name = T.extension(path), T.basename(path)
    out = F.when(F.lit(False), F.lit(""))
    for lang, own in LANGUAGES.items():
        out = out.when(ext.isin(*own), lang)
    for lang, own in NAMED.items():
        out = out.when((ext == "") & name.isin(*own), lang)
    return out


def file_type(path: Column) -> Column:
    """code, markdown, structured, tabular, log or other."""
    ext = T.extension(path)
    out = F.when(language(path).isNotNull(), "code")
    for kind, own in KINDS.items():
        out = out.when(ext.isin(*own), kind)
    return out.when((ext == "") & F.startswith(T.basename(path), F.lit(".env")), "structured").otherwise("other")


def is_binary(content: Column) -> Column:
    """A NUL in the first 512 bytes."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00")


def is_generated_name(path: Column) -> Column:
    return T.basename(path).isin(*GENERATED_NAMES)


def is_generated_text(text: Column) -> Column:
    return T.any_of(F.substring(text, 1, 512), GENERATED_MARKS)


def is_minified_name(path: Column) -> Column:
    """name.min.ext or name-min.ext; a leading dot is no separator."""
    return T.basename(path).rlike(r"(?i)^.+\.min\.[^.]*$|(?i)-min\.[^.]*$")


def is_minified_text(text: Column) -> Column:
    """Fewer than two line ends in the first 2,048 characters."""
    return F.length(F.regexp_replace(F.substring(text, 1, 2048), "[^\n]", "")) < 2


def has_regex_char(q: Column) -> Column:
    return q.rlike(r"[()\[\]{}*+?|\\^$]")


def is_identifier(q: Column) -> Column:
    return q.rlike(r"^[A-Za-z_$@][A-Za-z0-9_$.\-]*$")


def is_exact_symbol(q: Column) -> Column:
    """Case, qualification, an underscore, a hyphen or a sigil mark a name rather than a notion."""
    return q.rlike(r"^[A-Z]|::|[._-]|^[$@]|^[a-z].*[A-Z]")


def is_filename(q: Column) -> Column:
    return ~q.rlike("[ /]") & (q.rlike(r"^.+\.[^.]+$") | q.isin(*BARE_NAMES))


def classify(q: Column) -> Column:
    """Kind of a query: regex, glob, path, content, filename, symbol or concept; whether a path exists is not asked."""
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    return (
        F.when((F.length(q) >= 3) & q.rlike("^/.+/$") & has_regex_char(F.regexp_extract(q, "^/(.+)/$", 1)), "regex")
        .when(~F.contains(q, F.lit(" ")) & q.rlike(r"[*?{\[]"), "glob")
        .when(q.rlike(r"^\.\.?/") | (F.contains(q, F.lit("/")) & ~F.contains(q, F.lit(" "))), "path")
        .when(q.rlike("^[0-9]*$"), "content")
        .when(is_identifier(q) & is_exact_symbol(q), "symbol")
        .when(is_identifier(q), "concept")
        .when(F.contains(q, F.lit(" ")) & (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z0-9_-]+$")), "concept")
        .otherwise("content")
    )


def is_definition_line(line: Column, q: str | None = None) -> Column:
    """A line that begins like a definition, and holds the query if there is one."""
    found = starts(F.trim(line), DEFINES)
    return found if q is None else found & F.contains(line, F.lit(q))


def is_import_line(line: Column, lang: Column) -> Column:
    t = F.ltrim(line)
    return (
        F.when(lang == "rust", starts(t, ("use ",))).when(lang.isin("typescript", "tsx", "javascript"), starts(t, ("import ", "import{")))
        .when(lang == "python", starts(t, ("import ", "from "))).when(lang.isin("go", "java", "scala", "kotlin"), starts(t, ("import ",)))
        .when(lang.isin("c", "cpp"), starts(t, ("#include",))).when(lang == "elixir", starts(t, ("alias ", "import ", "use ", "require ")))
        .when(lang == "bash", t.rlike(r"^(?:source|\.)\s")).otherwise(False)
    )


# Fixed rules: where the source stands in an import line, by language; others name it after import, or after from.
IMPORT_SOURCES = {
    "bash": r"""^(?:source|\.)\s+["']*([^"'$]*)["']*;*$""", "elixir": r"^(?:use|import|alias|require) ([^,]*)", "rust": r"^use (.*?)(?:::)*\s*(?:\{.*)?;*$",
    "python": r"^(?:from|import)\s+([^\s;]+)", "c": r"^#include\s*(.*?)\s*;*$", "cpp": r"^#include\s*(.*?)\s*;*$",
}
IMPORT_SOURCE = r"""^import\s*(?:.*?from )?\s*["';]*(.*?)["';]*$"""


def import_source(line: Column, lang: Column) -> Column:
    """What an import line imports; empty where the line does not say."""
    t, out = F.trim(line), F.when(F.lit(False), F.lit(""))
    for own, pattern in IMPORT_SOURCES.items():
        out = out.when(lang == own, F.regexp_extract(t, pattern, 1))
    return F.trim(out.otherwise(F.regexp_extract(t, IMPORT_SOURCE, 1)))


def is_external(source: Column, lang: Column) -> Column:
    return (
        F.when(lang == "rust", ~starts(source, ("crate::", "self::", "super::"))).when(lang.isin("typescript", "tsx", "javascript"), ~starts(source, (".", "@/", "~/")))
        .when(lang.isin("python", "bash"), ~starts(source, (".",))).when(lang.isin("c", "cpp"), ~starts(source, ('"',))).otherwise(True)
    )


def is_stdlib(source: Column, lang: Column) -> Column:
    return (
        F.when(lang == "rust", starts(source, ("std::", "core::", "alloc::"))).when(lang == "python", F.substring_index(source, ".", 1).isin(*PYTHON_STDLIB))
        .when(lang == "go", F.substring_index(source, "/", 1).isin(*GO_STDLIB)).otherwise(False)
    )


def is_module_path(source: Column) -> Column:
    return ~F.contains(source, F.lit(" ")) & source.rlike(r"^[\p{L}\p{N}@.]")


def is_placeholder(name: Column) -> Column:
    return starts(name, ("<", "impl ")) | (F.length(name) == 1)


def family(lang: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, own in FAMILIES.items():
        out = out.when(lang.isin(*own), name)
    return out


def is_noise(line: Column, lang: Column) -> Column:
    """A line that only logs for debugging, or a plain comment without a mark to keep it."""
    t, out = F.trim(line), F.when(F.lit(False), F.lit(False))
    for name in FAMILIES:
        comment = F.startswith(t, F.lit(COMMENTS[name])) & ~starts(t, DOC_COMMENTS[name]) & ~T.any_of(F.upper(t), KEEP_MARKS)
        out = out.when(family(lang) == name, starts(t, DEBUG_LOGS[name]) | comment)
    return F.coalesce(out, F.lit(False))


# Short labels of kinds of symbols.
SHORT_KINDS = {"function": "fn", "struct": "struct", "class": "class", "enum": "enum", "type": "type", "interface": "trait", "constant": "const", "variable": "var", "immutable": "var"}


def short_kind(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SHORT_KINDS.items() for x in pair)), kind), F.lit(""))


def importance(line: Column, first: Column, last: Column) -> Column:
    """100 for a block's first and last line, 10 for control flow, errors and calls, 5 for openings, 1 for assignments."""
    t = F.trim(line)
    comment = starts(t, COMMENT_STARTS) | t.isin(*COMMENT_ENDS)
    flow = starts(t, FLOW_STARTS) | t.isin(*FLOW_WORDS)
    error = t.rlike(r"\?;?$") | T.any_of(t, ERROR_MARKS) | starts(t, ERROR_STARTS)
    return (
        F.when(first | last, 100).when((t == "") | comment, 0).when(flow | error | F.contains(t, F.lit("(")), 10)
        .when(F.endswith(t, F.lit("{")) & (F.length(t) > 1), 5).when(F.contains(t, F.lit("=")) | starts(t, ASSIGN_STARTS), 1).otherwise(0)
    )


def source_priority(path: Column) -> Column:
    """Preference among files of one stem."""
    ext = T.extension(path)
    return F.when(ext.isin("ts", "tsx"), 10).when(ext.isin("rs", "go", "java", "py", "c", "cpp", "cs", "kt", "swift", "scala"), 9).when(ext.isin("js", "jsx", "mjs", "cjs"), 7).otherwise(3)


# Media type by extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "wasm": "application/wasm", "mp3": "audio/mpeg", "mp4": "video/mp4", "ttf": "font/ttf", "woff": "font/woff", "woff2": "font/woff2"}


def mime(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for ext, kind in MIME.items():
        out = out.when(F.lower(T.extension(path)) == ext, kind)
    return out.otherwise("application/octet-stream")


def view_mode(length: Column, text: Column, path: Column, binary: Column, section: Column, outline_tokens: Column) -> Column:
    """How a file is shown: section, empty, binary, generated, minified, oversize, full or outline."""
    tokens = T.token_estimate(text)
    return (
        F.when(section, "section").when(length == 0, "empty").when(binary, "binary").when(is_generated_name(path) | is_generated_text(text), "generated")
        .when(is_minified_name(path) | ((length >= 100_000) & is_minified_text(text)), "minified").when(length > 500_000, "oversize")
        .when((tokens <= 6_000) | (outline_tokens * 100 >= tokens * 80), "full").otherwise("outline")
    )
