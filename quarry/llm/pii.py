"""Surrogates for personal data, in DataFrame functions only.

Entities are found by pattern and type.  Each is made of units (each part of a person's name,
of which the last is the surname; any other entity is one unit in canonical form).  A unit's
surrogate derives from a key, the unit's type and canonical form, and an attempt number; so
equal entities get equal surrogates in every document, however they are written, and nobody
without the key can tell which.  The key is ``KEY_SETTING`` of the session; ``TEST_KEY`` stands
in where none is set, for tests only, and an empty key is an error.  Surrogates keep type and
format: separators and lengths of numbers, Luhn digits and issuer of cards, the shape and script
of an e-mail's local part, gender and script of names, reserved ranges elsewhere (e-mail domains
under example.com, IPv4 from 240/4, area codes that begin with 0 or 1, SSN from 900).

A name is found behind a title (with a gender, or without one: Dr., Prof.) or a phrase that
introduces one.  Its parts may hold apostrophes, hyphens and inner capitals (O'Brien, Jean-Luc,
McDonald); an initial stays as it is.

Collision check: over the distinct units of all documents, no two units of a type may share
a surrogate and no surrogate may be a real unit of the corpus.  All but the first of
colliding units try again under the next attempt until none collides.  Few attempts above
zero are usual; up to ``LITERAL`` of them go into the plan as a map, more are joined.

Entities are exploded without their texts, and texts are not shuffled unless more than
``LITERAL`` units needed a new attempt; a frequent entity is one row of the unit table.

Defined results: null text stays null and empty text empty, both with no entities; text
without entities is returned unchanged; repeated rows are returned as often as they came; an
empty table gives no rows; of other columns only those asked for are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING, TEST_KEY = "spark.quarry.surrogates.key", "quarry-surrogates"
LITERAL, ATTEMPTS = 500, 64
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = r"Mr\.|Mister|Herr|Monsieur|Señor|господин|г-н"
FEMALE = r"Mrs\.|Ms\.|Frau|Madame|Mme|Señora|госпожа|г-жа"
NEUTRAL = r"Dr\.|Prof\.|Mx\.|[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo"
TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL}) ?"
INITIAL = r"\p{Lu}\."
PART = rf"(?:{INITIAL}|\p{{Lu}}\p{{L}}*(?:['’-](?!s(?!\p{{L}}))\p{{L}}+)*)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": rf"(?<!\d)(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)(?<!\d[.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?<!\d[.-])[2-6]\d{3}(?:\d{9,15}|(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{5})(?!\d)",
    "person": rf"(?<!\p{{L}}){TITLE}{PART}(?: {PART}){{0,3}}",
}
ENTITY = "|".join(PATTERNS.values())
#: What a text with a name contains.
TITLES = [t.replace("\\.", ".") for t in f"{MALE}|{FEMALE}".split("|")] + ["Dr.", "Prof.", "Mx.", "y name is", "ch heiße", "e m'appelle", "e llamo"]
TYPES = list(PATTERNS)

#: By script: consonants and vowels, of which syllables are made; endings of names without and with a female form.
LETTERS = {"latin": ("bdfgklmn", "aeio", ("n", "r"), ("a", "ine")), "cyrillic": ("бдфгклмн", "аеио", ("н", "р"), ("а", "ина")), "greek": ("βδφγκλμν", "αειο", ("ν", "ρ"), ("α", "ινα"))}
SYLLABLES = {script: ([c + v for c in consonants for v in vowels], plain, female) for script, (consonants, vowels, plain, female) in LETTERS.items()}


def kind(e: Column) -> Column:
    """The type of a match."""
    return (
        F.when(F.contains(e, F.lit("@")), "email").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(e.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^\d"), "card").otherwise("person")
    )


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn(number: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo 10."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - 9 * (c.cast("int") > 4).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def name_of(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{TITLE}", "")


def parts_of(e: Column) -> Column:
    """The parts of a person's name, without initials."""
    return F.filter(F.split(name_of(e), " "), lambda p: ~p.rlike(rf"^{INITIAL}$"))


def unit(type_: Column, canon: Column) -> Column:
    return F.struct(type_.alias("type"), canon.alias("canon"))


def units(e: Column) -> Column:
    """The units of an entity; none for a number that is no card."""
    k, parts = kind(e), parts_of(e)
    gender = F.when(e.rlike(rf"^(?:{FEMALE})"), "female").when(e.rlike(rf"^(?:{MALE})"), "male").otherwise("any")
    role = lambda i: F.when(i == F.size(parts) - 1, "surname").otherwise(F.concat(F.lit("given:"), gender))
    named = F.transform(parts, lambda p, i: unit(F.concat_ws(":", role(i), script(p)), F.lower(p)))
    none = F.array().cast("array<struct<type:string,canon:string>>")
    return (
        F.when(k == "person", named)
        .when(k == "email", F.array(unit(k, F.lower(e)))).when(k == "ip", F.array(unit(k, e)))
        .when((k == "card") & (luhn(digits(e)) != 0), none)
        .otherwise(F.array(unit(k, F.concat(F.when(F.startswith(e, F.lit("+")), "+").otherwise(""), digits(e)))))
    )


def byte(hex_: Column, i: Column) -> Column:
    """The i-th of a digest's 32 bytes, as a number."""
    return F.conv(F.substr(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def fresh_digits(hex_: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (byte(hex_, i) % 10).cast("string")), "")


def fresh_letters(hex_: Column, start: int, n: int) -> Column:
    return F.concat(*(F.char(97 + byte(hex_, F.lit(start + i)) % 26) for i in range(n)))


def _of(pool: Column, n: int):
    return lambda b: F.get(pool, b % n)


def fresh_local(hex_: Column, local: Column, attempt: Column) -> Column:
    """A local part of the same shape: letters of the same script, digits for digits, other characters as they are; longer from the eighth attempt on."""
    letters = {"a": "abcdefghijklmnopqrstuvwxyz", "б": "абвгдежзиклмнопрстуфхцчшэюя", "β": "αβγδεζηθικλμνξοπρστυφχψω"}
    pools = {k: F.array(*map(F.lit, v)) for k, v in letters.items()}

    def fresh(c: Column, i: Column) -> Column:
        b = byte(common.again(hex_, F.floor(i / 32)), (i % 32).cast("int"))
        letter = lambda k: F.get(pools[k], b % len(letters[k]))
        return F.when(c.rlike(r"\p{N}"), (b % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), letter("б")).when(c.rlike(r"\p{IsGreek}"), letter("β")).when(c.rlike(r"\p{L}"), letter("a")).otherwise(c)

    shape = F.concat(local, F.when(attempt >= 8, F.lit("aaaa")).otherwise(""))
    return F.array_join(F.transform(F.split(shape, ""), fresh), "")


def fresh_name(hex_: Column, type_: Column, attempt: Column) -> Column:
    """Two to four syllables, longer from the eighth attempt on; an ending by gender."""
    out = None
    for alphabet, (syllables, plain, female) in SYLLABLES.items():
        pool = F.array(*map(F.lit, syllables))
        count = F.when(attempt < 8, 3).otherwise(6)
        core = F.array_join(F.transform(F.transform(F.sequence(F.lit(0), count - 1), lambda i: byte(hex_, i)), _of(pool, len(syllables))), "")
        pick = byte(hex_, F.lit(20)) % 2
        ending = F.when(type_.like("given:female%"), F.get(F.array(*map(F.lit, female)), pick)).otherwise(F.get(F.array(*map(F.lit, plain)), pick))
        name = F.initcap(F.concat(core, ending))
        out = F.when(F.endswith(type_, F.lit(alphabet)), name) if out is None else out.when(F.endswith(type_, F.lit(alphabet)), name)
    return out


def surrogate(key: str, type_: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of a unit."""
    hex_ = common.keyed(key, type_, canon, attempt.cast("string"))
    n = F.length(digits(canon))
    number = fresh_digits(hex_, n)
    domain = common.keyed(key, F.lit("domain"), F.substring_index(canon, "@", -1))
    email = F.concat(fresh_local(hex_, F.substring_index(canon, "@", 1), attempt), F.lit("@"), fresh_letters(domain, 0, 6), F.lit(".example.com"))
    ip = F.concat_ws(".", (240 + byte(hex_, F.lit(0)) % 15).cast("string"), *(byte(hex_, F.lit(i)).cast("string") for i in (1, 2, 3)))
    # the country code of a number that begins with + stays: one digit for +1, else two
    code = F.when(F.startswith(canon, F.lit("+1")), 1).when(F.startswith(canon, F.lit("+")), 2).otherwise(0)
    area = (byte(hex_, F.lit(31)) % 2).cast("string")
    phone = F.concat(F.substr(canon, F.lit(1), code + (code > 0).cast("int")), area, F.substr(number, code + 2))
    ssn = F.concat(F.lit("9"), F.substr(number, F.lit(2)))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(number, F.lit(2), n - 2))
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    return (
        F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "phone", phone).when(type_ == "ssn", ssn)
        .when(type_ == "card", card).otherwise(fresh_name(hex_, type_, attempt))
    )


def dressed(e: Column, new: Column) -> Column:
    """An entity written like e whose units' surrogates are new."""
    k = kind(e)
    gaps, number = F.split(e, r"\d", -1), digits(F.get(new, F.lit(0)))
    n = F.length(number)
    formatted = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get(gaps, i), F.substr(number, i + 1, F.lit(1)))), ""), F.get(gaps, n))
    title, parts = F.regexp_extract(e, rf"^{TITLE}", 0), F.split(name_of(e), " ")
    before = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda p: ~p.rlike(rf"^{INITIAL}$")))
    name = F.array_join(F.transform(parts, lambda p, i: F.when(p.rlike(rf"^{INITIAL}$"), p).otherwise(F.get(new, before(i)))), " ")
    return (
        F.when(F.size(new) == 0, e).when(k == "person", F.concat(title, name))
        .when(k.isin("email", "ip"), F.get(new, F.lit(0))).otherwise(formatted)
    )


def entities(text: Column) -> Column:
    """All matches in a text.  Texts without a digit, an @ or a title are not searched."""
    likely = reduce(lambda a, b: a | b, [text.rlike("[0-9@]"), *(F.contains(text, F.lit(t)) for t in TITLES)])
    return F.when(likely, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets; the test key where it sets none."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def attempts(docs: DataFrame, key: str) -> DataFrame:
    """(type, canon, attempt) of the units whose first surrogate collides."""
    found = docs.select(F.explode(F.array_distinct(entities(F.col("text")))).alias("e")).distinct()
    known = found.select(F.explode(units(F.col("e"))).alias("u")).select("u.*").distinct().withColumn("attempt", F.lit(0))
    known = common.materialize(known, "pii-units")
    for _ in range(ATTEMPTS):
        named = known.withColumn("new", surrogate(key, F.col("type"), F.col("canon"), F.col("attempt")))
        shared = named.groupBy("type", "new").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = named.join(shared.hint("merge"), ["type", "new"]).where("canon <> first.canon").select("type", "canon")
        real = named.alias("s").join(known.hint("merge").alias("r"), (F.col("s.type") == F.col("r.type")) & (F.lower("s.new") == F.col("r.canon"))).select("s.type", "s.canon")
        lost = common.materialize(again.union(real).distinct().withColumn("lost", F.lit(1)), "pii-lost")
        if lost.isEmpty():
            break
        known = known.join(lost.hint("merge"), ["type", "canon"], "left").select("type", "canon", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt"))
        known = common.materialize(known, "pii-units")
    else:
        raise RuntimeError("surrogates still collide; the format has too few values for its entities")
    return known.where("attempt > 0")


def replaced(docs: DataFrame, carry: list[str], key: str | None = None, literal: int = LITERAL) -> DataFrame:
    """The carried columns of docs, text with surrogates, and entities: those found.  key: the session's if None."""
    key = session_key(docs.sparkSession) if key is None else key
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a key; without one anybody can derive the surrogates")
    again = attempts(docs.select(F.col("text").cast("string").alias("text")), key)
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in carry], F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("entities", entities(F.col("text")))
    few = again.limit(literal + 1).collect()  # bounded
    name = lambda u: F.concat_ws("\x1f", u["type"], u["canon"])
    if not few:
        attempt = lambda u: F.lit(0)
    elif len(few) <= literal:
        table = F.create_map(*(x for r in few for x in (F.lit(f"{r['type']}\x1f{r['canon']}"), F.lit(r["attempt"]))))
        attempt = lambda u: F.coalesce(F.try_element_at(table, name(u)), F.lit(0))
    else:
        rows = rows.withColumn("own", F.xxhash64(*[f"_{c}" for c in carry], "text"))
        seen = rows.select("own", F.explode(F.array_distinct(F.flatten(F.transform("entities", units)))).alias("u")).select("own", "u.*").distinct()
        maps = seen.join(again, ["type", "canon"]).groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct(name({"type": F.col("type"), "canon": F.col("canon")}), "attempt"))).alias("table"))
        rows = rows.join(common.materialize(maps, "pii-maps"), "own", "left")
        attempt = lambda u: F.coalesce(F.try_element_at(F.col("table"), name(u)), F.lit(0))
    one = lambda e: dressed(e, F.transform(units(e), lambda u: surrogate(key, u["type"], u["canon"], attempt(u))))
    rows = rows.withColumn("new", F.transform("entities", one))
    gaps = F.split("text", ENTITY, -1)
    woven = F.array_join(F.zip_with(gaps, "new", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    text = F.when(F.size("entities") > 0, woven).otherwise(F.col("text"))
    kept = F.filter("entities", lambda e: F.size(units(e)) > 0)
    return rows.select(*[F.col(f"_{c}").alias(c) for c in carry], text.alias("text"), kept.alias("entities"))


def _is(value: str):
    return lambda x: x == value


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and its entities by type."""
    found = replaced(common.table(spark, sf_dir, "documents"), ["doc_id"])
    of_type = {t: F.size(F.filter(F.transform("entities", kind), _is(t))) for t in TYPES}
    counts = [n.cast("long").alias(f"n_{t}") for t, n in of_type.items()]
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *counts)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with surrogates in their texts (n_chars recounted where a text changed)."""
    found = replaced(docs, ["doc_id", "lang", "source", "n_chars"])
    n = F.when(F.size("entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", "text", "lang", "source", n.alias("n_chars"))
