"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector of ``DIMENSIONS``, drawn from a seed and its code
point.  A trigram binds its letters: the elementwise product of the first letter's vector
permuted twice, the second's permuted once and the third's.  A document bundles (sums) the
vectors of all its trigrams; a language's prototype bundles the normalized documents of its
training rows.  A document gets the language whose prototype has the largest cosine.

Letters are lower-cased; every run of other characters is one boundary symbol.  The whole
text counts, in pieces that lose no trigram at their cuts.  Training reads at most about
``FIT_ROWS`` labelled documents of each language, those with the smallest hashes; prototypes
are summed before the shuffle, so that only one vector for each language and partition
travels.  More than ``MOST_LANGUAGES`` values of lang are an error, as a model holds them all.

Defined results: null text, empty text and text without a letter give ``und`` and score 0;
without any labelled training row every document is ``und``; equal cosines go to the
language that is first by code point; repeated rows are returned as often as they came; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS, FIT_ROWS, SEED, UNKNOWN = 1024, 4_000, 5, "und"
BLOCK_LETTERS, BLOCK_DOCS, MOST_LANGUAGES = 1 << 20, 256, 4_096


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(len(out)):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


class Space:
    """Vectors of letters and trigrams; trigrams are kept in a bounded table."""

    LIMIT = 40_000

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letter: dict[int, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self._at: dict[int, int] = {}
        self._rows = np.empty((1024, self.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letter:
            draw = np.random.default_rng((self.seed, code))
            self._letter[code] = draw.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self._letter[code]

    def bind(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, grams: list[int]) -> np.ndarray:
        if len(self._at) + len(grams) > self.LIMIT:
            self._reset()
        new = [g for g in grams if g not in self._at]
        need = len(self._at) + len(new)
        if need > len(self._rows):
            more = np.empty((max(need, 2 * len(self._rows)), self.dimensions), np.float32)
            more[: len(self._at)] = self._rows[: len(self._at)]
            self._rows = more
        for g in new:
            self._rows[len(self._at)] = self.bind(g)
            self._at[g] = len(self._at)
        return self._rows[[self._at[g] for g in grams]]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The document vectors of texts; a text without a letter has a zero vector."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < BLOCK_DOCS and (end == at or size + len(texts[end]) <= BLOCK_LETTERS):
                size += len(texts[end])
                end += 1
            self._block(texts[at:end], out[at:end])
            at = end
        return out

    def _block(self, texts: list[str], out: np.ndarray) -> None:
        gram, doc = [], []
        for k, text in enumerate(texts):
            for g in trigrams(text, BLOCK_LETTERS):
                g, n = np.unique(g, return_counts=True)
                gram.append(g)
                doc.append((k, n))
        if not gram or not sum(map(len, gram)):
            return
        known, at = np.unique(np.concatenate(gram), return_inverse=True)
        count = np.zeros((len(texts), len(known)), np.float32)
        edge = np.cumsum([0, *map(len, gram)])
        for (k, n), a, b in zip(doc, edge, edge[1:], strict=False):
            count[k, at[a:b]] += n
        for a in range(0, len(known), self.LIMIT // 4):
            out += count[:, a : a + self.LIMIT // 4] @ self.vectors(known[a : a + self.LIMIT // 4].tolist())


def trigrams(text: str, piece: int) -> Iterator[np.ndarray]:
    """Codes of the trigrams of letters and boundaries, for each piece of the text; none if there is no letter.

    The last two symbols before a cut go on in the next piece, so pieces give what the whole text gives.
    """
    last = np.zeros(1, np.int64)  # the text's first boundary
    for at in range(0, len(text), piece):
        c = letters()[np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), "<u4")]
        c = np.concatenate([last, c, np.zeros(int(at + piece >= len(text)), np.int64)])
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        if len(c) >= 3:
            yield c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        last = c[-2:]


_space: Space | None = None


def space() -> Space:
    """One for each worker process."""
    global _space
    if _space is None:
        _space = Space()
    return _space


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> "Model":
    """Languages and their prototypes, from labelled documents that aren't held out."""
    labelled = docs.where(F.coalesce(~held_out(), F.lit(True)) & F.col("lang").isNotNull())
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(SEED), "doc_id").alias("h"))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values; a model holds a vector for each")
    if not known:
        return [], np.zeros((0, DIMENSIONS))
    share = F.create_map(*(F.lit(x) for r in known for x in (r["lang"], min(1.0, rows / r["n"]))))
    chosen = labelled.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            found = unit(space().bundle([t or "" for t in batch.column(1).to_pylist()]))
            lang = np.array(batch.column(0).to_pylist())
            for x in set(lang.tolist()):
                total[x] = total.get(x, 0) + found[lang == x].sum(0, dtype=np.float64)
        rows = [(x, k, float(y)) for x, v in total.items() for k, y in enumerate(v)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "k", "y"])

    sums = chosen.mapInArrow(run, "lang string, k int, y double").groupBy("lang", "k").agg(F.sum("y").alias("y"))
    names = sorted(r["lang"] for r in known)
    out = np.zeros((len(names), DIMENSIONS))
    for r in sums.collect():  # a vector for each language
        out[names.index(r["lang"]), r["k"]] = r["y"]
    return names, unit(out)


Model = tuple[list[str], np.ndarray]


def identify(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Language and cosine (0 to 1) of each text."""
    names, prototypes = model
    found = unit(space().bundle(texts))
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    cosine = found @ prototypes.T
    best, known = cosine.argmax(1), found.any(1)
    score = np.where(known, cosine[np.arange(len(best)), best].clip(0, 1), 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score.tolist()


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = fit(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = identify([t or "" for t in batch.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the predicted language of every document."""
    return predict(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognizable language go; the others keep all columns."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _ = identify([t or "" for t in batch.column(1).to_pylist()], model)
            yield batch.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return rows.mapInArrow(run, rows.schema)
