"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document becomes token ids plus an end id, is cut into full windows of ``capacity``
ids, and its rest into pieces of at most ``piece`` ids.  Pieces are dealt by hash to
groups of about ``group`` pieces.  Within a group, the pieces in descending order fill
partial partitions of one slot per window; the two partial partitions with the largest
imbalance are merged again and again, largest slot of one onto smallest slot of the other,
until one partition with near-equal windows is left.  If a window exceeds the capacity,
the group starts again with more windows.

Token ids never travel: the cuts depend on the document alone, so only lengths and
checksums are shuffled.  A group is bounded whatever the input's size, and no group
depends on a key of the data, so nothing can be skewed.

Tokenizing works by word: no token of this family spans white space, so the ids of a text
are those of its words, and each worker keeps a bounded cache of words.

Defined results: null or empty text gives the end id alone; repeated rows are packed as
often as they come; a null doc_id stays null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID, PIECE, GROUP = 2048, 1, 512, 4096
CACHE_WORDS = 200_000
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WordIds(dict):
    """Word (bytes, A-Z lowered) to its ids (little-endian 32-bit), filled on demand.

    Two generations bound it: once the younger is full it becomes the older, and words
    still in use move over.  New words of letters alone are one token run each; they are
    encoded together and told apart by the tokens that end a word.  Trailing punctuation
    is a run of its own, so it is split off before words are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self._encode, self._encode_many = tokenizer.encode, tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self._older.get(word)
        if found is None:
            head = word.rstrip(PUNCTUATION)
            if len(head) != len(word) and head[-1:].isalpha() and b"<|" not in word:
                return self[head] + self[word[len(head) :]]  # not kept: its parts are
            found = array("I", self._encode(word.decode("utf-8"), None, False, False).ids).tobytes()
        self[word] = found
        return found

    def _learn(self, words: list[bytes]) -> None:
        """Takes in new words, those of letters alone in one encoding."""
        if len(self) >= CACHE_WORDS:
            self._older = dict(self)
            self.clear()
        older, batch, texts = self._older.get, [], []
        for word in words:
            found = older(word)
            if found is not None:
                self[word] = found
            elif (text := word.decode("utf-8")).isalpha():
                batch.append(word)
                texts.append(text)
        if not batch:
            return
        ids = np.array(self._encode_many([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.flatnonzero(self._ends[ids])
        if len(stop) != len(batch):  # lower case made more than letters of some letter
            return
        raw, start = ids.tobytes(), 0
        for word, end in zip(batch, ((stop + 1) * 4).tolist(), strict=True):
            self[word] = raw[start:end]
            start = end

    def text(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        if b"<|" in text:  # special tokens are matched before lowering
            return b"".join(map(self.__getitem__, text.split()))
        a = np.frombuffer(text.lower(), np.uint8)
        words = np.insert(a, tails(a), 32).tobytes().split()
        if new := list(filterfalse(self.__contains__, set(words))):
            self._learn(new)
        return b"".join(map(self.__getitem__, words))


CLASS = np.zeros(256, np.uint8)  # 1 punctuation, 2 white space, 3 a-z, 0 anything else
CLASS[list(PUNCTUATION)], CLASS[[32, 9, 10, 11, 12, 13]], CLASS[97:123] = 1, 2, 3


def tails(a: np.ndarray) -> np.ndarray:
    """Where punctuation begins that follows a letter and lasts to the word's end: it can be a word of its own."""
    kind = CLASS[a]
    mark = kind == 1
    start = np.flatnonzero(mark[1:] & (kind[:-1] == 3)) + 1
    if not len(start):
        return start
    after = np.append(np.flatnonzero(mark[:-1] & ~mark[1:]) + 1, len(a))
    end = after[np.searchsorted(after, start, side="right")]
    return start[(end == len(a)) | (kind[np.minimum(end, len(a) - 1)] == 2)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache for each worker process and tokenizer."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows, then equal pieces of the rest."""
    out = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    if at < n:
        parts = -(-(n - at) // piece)
        size, more = divmod(n - at, parts)
        for k in range(parts):
            out.append((at, size + (k < more)))
            at += size + (k < more)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID, include_ids: bool = False) -> DataFrame:
    """One row per piece; with include_ids also its ids (array of int)."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path).text
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(0), texts, strict=True):
                ids = encode(text.as_py() or b"") + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, piece):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id.as_py(), start, length, zlib.crc32(own), n)
                    rows.append((*row, np.frombuffer(own, "<u4").tolist()) if include_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            columns = zip(*rows, strict=True) if rows else [[]] * (5 + include_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: 5 + include_ids])

    schema = PIECES + (", ids array<int>" if include_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item (sizes descending), by multiway differencing."""
    n = len(sizes)
    rounds = -(-n // windows)
    slots = np.full(rounds * windows, -1)
    slots[:n] = np.arange(n)
    parts = slots.reshape(rounds, windows)
    load = np.where(parts >= 0, sizes[parts], 0)
    # a partial partition: its sums in descending order, and a column of items for each slot
    heap = [(-int(s[0] - s[-1]), k, s, p[None, :]) for k, (s, p) in enumerate(zip(load, parts, strict=True))]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, s, p = heapq.heappop(heap)
        _, _, t, q = heapq.heappop(heap)
        s, p = s + t[::-1], np.concatenate([p, q[:, ::-1]])
        order = np.argsort(-s, kind="stable")
        s, p = s[order], p[:, order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), fresh, s, p))
        fresh += 1
    p = heap[0][3]
    out = np.empty(n, np.int64)
    row, column = np.nonzero(p >= 0)
    out[p[row, column]] = column
    return out


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each item; items of full capacity get windows of their own."""
    window, offset = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = sizes >= capacity
    window[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    if len(rest):
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        own = sizes[rest]
        count = max(1, -(-int(own.sum()) // capacity))
        while True:
            got = difference(own, count)
            if np.bincount(got, own, count).max() <= capacity:
                break
            count += max(1, count // 1000)
        order = np.argsort(got, kind="stable")
        end = np.cumsum(own[order])
        first = np.r_[True, got[order][1:] != got[order][:-1]]
        base = np.maximum.accumulate(np.where(first, end - own[order], 0))
        offset[rest[order]] = end - own[order] - base
        window[rest] = got + full.sum()
    return window, offset


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = found.sparkSession
    groups = max(1, -(-found.count() // group))
    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    names = found.columns
    dealt = dealt.select("g", *names).repartition(min(groups, common.partitions(spark)), "g")
    dealt = dealt.sortWithinPartitions("g", F.desc("length"), "doc_id", "start", "ids_crc32")
    at = 1 + names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            window, offset = pack_group(t.column(at).to_numpy(), capacity)
            sequence = (int(t.column(0)[0].as_py()) << 32) + window
            return pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks() for i in range(1, t.num_columns)), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(edge, edge[1:], strict=False):
                if held and a < b and held[-1].column(0)[0].as_py() != g[a]:
                    yield solved(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield solved(pa.Table.from_batches(held))

    schema = ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, include_ids: bool = False) -> DataFrame:
    """Documents to packed pieces."""
    found = common.materialize(pieces(docs, tokenizer, capacity, include_ids=include_ids), "packing")
    return pack(found, capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per piece of every document."""
    return packed(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: packs all that is left."""
    return packed(docs)
