"""Column functions over text: tokens, hashes, word boundaries, labels, path predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names whose files rank lower.
VENDOR_DIRS = ("node_modules", "vendor", "dist", "build", ".git", "target", "__pycache__", ".venv", "venv", "pkg", "out")
# Path parts of test files, for ranking and for facets.
TEST_PARTS = (".test.", ".spec.", "__tests__/")
FACET_TEST_PARTS = ("_test.", "/test/", "/tests/", "_spec.", "/spec/")
# Documentation files.
DOC_EXTENSIONS = ("md", "mdx", "txt", "rst")


def token_estimate(text: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def token_label(tokens: Column) -> Column:
    """~12, or ~1.2k (floored) from 1,000 on."""
    return F.when(tokens < 1000, F.concat(F.lit("~"), tokens.cast("string"))).otherwise(F.concat(F.lit("~"), F.floor(tokens / 1000).cast("string"), F.lit("."), F.floor(tokens % 1000 / 100).cast("string"), F.lit("k")))


def map_label(tokens: Column) -> Column:
    """12, 1.2k (rounded) from 1,000 on, 1.0M from what would round to 1000.0k."""
    decimal = lambda n, s: F.concat(F.format_string("%.1f", tokens / F.lit(float(n))), F.lit(s))
    return F.when(tokens >= 999_950, decimal(1_000_000, "M")).when(tokens >= 1000, decimal(1000, "k")).otherwise(tokens.cast("string"))


def header(path: Column, length: Column, lines: Column, mode: Column) -> Column:
    """# path (12 lines, ~1.2k tokens) [mode]"""
    label = token_label(F.floor((length + 3) / 4).cast("long"))
    return F.concat(F.lit("# "), path, F.lit(" ("), lines.cast("string"), F.lit(" lines, "), label, F.lit(" tokens) ["), mode, F.lit("]"))


def size_label(n: Column) -> Column:
    """Bytes, whole kilobytes, or megabytes with one decimal."""
    mb = F.concat(F.floor(n / 1048576).cast("string"), F.lit("."), F.floor(n % 1048576 * 10 / 1048576).cast("string"), F.lit("MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1048576, F.concat(F.floor(n / 1024).cast("string"), F.lit("KB"))).otherwise(mb)


def age_label(seconds: Column) -> Column:
    """12s, 5m, 3h or 9d."""
    unit = lambda n, s: F.concat(F.floor(seconds / n).cast("string"), F.lit(s))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes as an array of int."""
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")  # one for each byte, in one pass
    each = F.transform(chars, lambda c: F.ascii(c).cast("long"))
    return F.when(F.octet_length(text) > 0, each).otherwise(F.array().cast("array<long>"))


def fnv12(text: Column) -> Column:
    """Low 12 bits of 32-bit FNV-1a."""
    folded = F.aggregate(bytes_of(text), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return folded.bitwiseAND(F.lit(4095).cast("long")).cast("int")


def anchor(line: Column, text: Column) -> Column:
    """line:hash as an edit anchor."""
    return anchor_of(line, fnv12(text))


def anchor_of(line: Column, hashed: Column) -> Column:
    """The same from a line's hash."""
    return F.concat(line.cast("string"), F.lit(":"), F.lpad(F.lower(F.hex(hashed)), 3, "0"))


def anchor_parts(anchor: Column) -> Column:
    """struct(line, hash) of line:hash; null for what is no anchor."""
    ok = anchor.rlike("^[0-9]{1,9}:[0-9a-fA-F]{1,3}$")
    line, hashed = F.substring_index(anchor, ":", 1).cast("int"), F.conv(F.substring_index(anchor, ":", -1), 16, 10).cast("int")
    return F.when(ok, F.struct(line.alias("line"), hashed.alias("hash")))


def quoted(q: str) -> str:
    """q as a literal part of a Java and RE2 pattern."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}/-" else c for c in q)


def whole_word(text: Column, q: str) -> Column:
    """q between Unicode word boundaries."""
    return text.rlike(rf"(?U)\b{quoted(q)}\b")


def whole_identifier(text: Column, q: str) -> Column:
    """q with no ASCII word character on either side."""
    return text.rlike(rf"(?<![A-Za-z0-9_]){quoted(q)}(?![A-Za-z0-9_])")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def is_test_path(path: Column) -> Column:
    return any_of(path, TEST_PARTS)


def is_test_facet(path: Column, text: Column) -> Column:
    # Text marks of a test.
    marks = ("#[test]", "#[cfg(test)]", "@Test", "def test_", 'it("', "it('", 'describe("', "describe('", "func Test")
    return any_of(path, FACET_TEST_PARTS) | any_of(text, marks)


def is_vendor_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS)))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_doc_path(path: Column) -> Column:
    return extension(path).isin(*DOC_EXTENSIONS) | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("docs"), F.lit("doc")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normalized_path(path: Column) -> Column:
    """Lexical: no '.', and '..' takes the part before it where there is one."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    pairs = F.zip_with(F.split(dirname(a), "/"), F.split(dirname(b), "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, F.lit(False))
    return F.when(first == 0, F.size(pairs)).otherwise(first - 1).cast("int")


def recency(mtime: Column, now: Column) -> Column:
    """100, 80, 50, 20 or 0 by age: an hour, a day, a week, 30 days.  Each time counts to its nearest second, halves to the even one."""
    seconds = lambda t: F.rint(F.unix_micros(t.cast("timestamp")) / F.lit(1e6)).cast("long")
    age = seconds(now) - seconds(mtime)
    return F.when(age < 3600, 100).when(age < 86400, 80).when(age < 604800, 50).when(age < 2592000, 20).otherwise(0)


def bigrams(text: Column) -> Column:
    """Character pairs, white space removed; repeats stay."""
    s = F.regexp_replace(text, r"\s+", "")
    n = F.length(s)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice of two arrays as multisets: twice the shared over all; 1 for two empty ones."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading, else 0."""
    return F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(line, r"^ {0,3}#{1,6}[ \t]+(.*)$", 1), r"[ \t]+#+[ \t]*$", ""))
