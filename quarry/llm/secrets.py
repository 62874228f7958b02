"""Secret scan: fixed patterns and character Markov models.

Patterns give the base spans.  Beside them, every run of token characters is scored by
first-order Markov models of characters, of random strings and of ordinary
identifiers and words; where the log-likelihood ratio exceeds a threshold in all and for a
character, the run becomes a span of kind ``markov`` unless it touches a base span.  Random
strings have a model for each alphabet, all equally likely beforehand.

The models are trained on labelled samples of bounded size.  Ordinary: the words, outside of
base spans, of the ``TRAIN_DOCS`` different documents of smallest hash, and identifiers made of
them.  Random: strings from a seeded generator over the usual alphabets, and what base spans of
those documents hold.  Workers count transitions; the driver gets their sums only, a number
for each pair of characters.

Defined results: null text is empty; offsets are code points, ends exclusive; empty text
has no spans; repeated rows are returned as often as they came; an empty table gives no
rows (the models then know only random strings and add no span); other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so a shorter one can't hide a longer one
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PLAIN = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Bounded training sample, and the least evidence: nats a character, and in all.
TRAIN_DOCS, RANDOM_STRINGS, SEED = 2_000, 20_000, 11
PER_CHARACTER, IN_ALL = 0.5, 12.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(run: str) -> np.ndarray:
    return CODE[np.frombuffer(run.encode("ascii"), np.uint8)]


def counted(strings: Iterable[str]) -> np.ndarray:
    """How often each character follows each other; the last row is the start."""
    n = len(ALPHABET)
    count = np.zeros((n + 1, n))
    for s in strings:
        c = codes(s)
        count[n, c[0]] += 1
        np.add.at(count, (c[:-1], c[1:]), 1)
    return count


def likelihoods(count: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log-probabilities of the next character.  Rare rows lean on how frequent characters are."""
    single = count.sum(0) + 0.5
    count = count + weight * single / single.sum()
    return np.log(count / count.sum(1, keepdims=True))


def random_strings(n: int = RANDOM_STRINGS, seed: int = SEED) -> list[list[str]]:
    """Labelled samples of random strings: hexadecimal, base 32, base 36, base 62 and base 64, a list for each alphabet."""
    draw = random.Random(seed)
    digits, upper, lower = "0123456789", ALPHABET[:26], ALPHABET[26:52]
    kinds = (digits + "abcdef", upper + "234567", digits + lower, upper + digits, digits + upper + lower, digits + upper + lower + "+/", digits + upper + lower + "-_")
    return [["".join(draw.choices(kind, k=draw.randint(16, 64))) for _ in range(n // len(kinds))] for kind in kinds]


def labelled(text: str) -> tuple[list[str], list[str]]:
    """(ordinary, random): words outside of base spans with few digits, with identifiers made of them; what base spans hold."""
    words, secret, at = [], [], 0
    for a, b, _ in [*base_spans(text), (len(text), len(text), "")]:
        words += [w for w in PLAIN.findall(text[at:a]) if sum(c.isdigit() for c in w) * 6 < len(w)]
        secret += RUN.findall(text[a:b])
        at = max(at, b)
    made = [w.upper() for w in words[::4]]
    made += [w.capitalize() + v.capitalize() for w, v in zip(words[1::8], words[2::8], strict=False)]
    made += [f"{w}_{v}{k % 10}" for k, (w, v) in enumerate(zip(words[3::8], words[5::8], strict=False))]
    return words + made, secret


def trained(docs: DataFrame, sample: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Transition counts of ordinary and of random strings in the sample of documents."""
    marked = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    out = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET)))
    if last is None:
        return out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(out)
        for batch in batches:
            for value in batch.column(0):
                for k, strings in enumerate(labelled(value.as_py() or "")):
                    total[k] += counted(strings)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], ["place", "n"])

    found = marked.where(F.col("h") <= last).select("text").mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a number for each pair of characters
        out.ravel()[r["place"]] = r["n"]
    return out[0], out[1]


def ratio(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition: random, by alphabet, against ordinary."""
    ordinary, found = trained(docs)
    if not ordinary.any():
        return np.full((1, len(ALPHABET) + 1, len(ALPHABET)), -1.0)
    models = [counted(strings) for strings in random_strings()] + [found] * bool(found.any())
    return np.stack([likelihoods(c) for c in models]) - likelihoods(ordinary)


def score(run: str, table: np.ndarray) -> float:
    """Log-likelihood ratio of a run: a string of any alphabet, all equally likely, against an ordinary one."""
    c = codes(run)
    return float(np.logaddexp.reduce(table[:, len(ALPHABET), c[0]] + table[:, c[:-1], c[1:]].sum(1)) - math.log(len(table)))


def markov_spans(text: str, table: np.ndarray, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if m[0].isdigit() or any(s < b and a < e for s, e, _ in taken):  # a long number is no secret by its characters
            continue
        if score(m[0], table) >= max(IN_ALL, PER_CHARACTER * (b - a)):
            out.append((a, b, "markov"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (kind:start:end), n_assign, n_access, n_hex, n_markov."""
    table = ratio(docs) if table is None else table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_col, span_col = [], []
            count: dict[str, list[int]] = {k: [] for k in KINDS}
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = markov_spans(text, table, base)
                base_col.append(joined(base))
                span_col.append(joined(base + more))
                for k in KINDS:
                    count[k].append(sum(s[2] == k for s in base) if k != "markov" else len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_col, pa.string()), pa.array(span_col, pa.string()), *(pa.array(count[k], pa.int64()) for k in KINDS)], ["doc_id", "base", "spans", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the secrets of every document."""
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")
