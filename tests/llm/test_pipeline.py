"""The pipeline's stages on the smallest documents."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, packing, pii, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    before = docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) < before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert out.agg({"length": "sum"}).first()[0] == packing.pieces(docs).agg({"length": "sum"}).first()[0]


def test_run_agrees(spark):
    key = lambda: sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())
    assert key() == key()


def test_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def small_table():
    """Documents with nulls, repeated and missing ids, copies, near copies, personal data, and none of a language."""
    draw = np.random.default_rng(3)
    stock = [a + b for a in "the and of tion ere ing her est ion ould".split() for b in "ment ver con per ing ald".split()]
    words = lambda n: " ".join(draw.choice(stock, n))
    base = words(400)
    rows = [(i, words(int(draw.integers(1, 900))), "en", f"s{i % 4}") for i in range(30)]
    rows += [(30 + i, base, "en", "s1") for i in range(3)] + [(40, base + " more", "en", "s2"), (41, base, "en", None)]
    rows += [(50, None, "en", "s1"), (51, "", "fr", "s1"), (52, "12 !! 34", "en", "s1"), (None, words(70), "en", "s3"), (None, words(80), "en", "s3"), (7, words(60), "en", "s0"), (7, words(60), "en", "s0"), (60, "one", None, None)]
    rows += [(70, "mail jo.doe@site.org " + words(90), "en", "s2"), (71, "call 555-123-4567 " + words(50), "en", "s0")]
    return rows


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def kept_by_rule(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    marks, label = [fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if bin(a ^ b).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    best: dict = {}
    for r, k in zip(rows, label, strict=True):
        if k not in best or (r[0] is None, r[0] or 0) < (best[k][0] is None, best[k][0] or 0):
            best[k] = r
    return list(best.values())


def mixed_by_rule(rows):
    """(doc_id, text) of every copy that the mix takes."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    by: Counter = Counter()
    for r in rows:
        by[r[3]] += len(words(r[1]))
    names = sorted((s for s in by if s is not None), key=str.encode) + [None] * (None in by)
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(by.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not (over := [s for s in open_ if share[s] > 3 * by[s]]):
            target |= share
            break
        target |= {s: 3.0 * by[s] for s in over}
        open_ -= set(over)
    out = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (int(hashlib.md5(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] or 0, len(words(r[1]))))
        goal, at = int(target[s] + 1e-9), 0
        for r in own:
            n = len(words(r[1]))
            out += [(r[0], r[1])] * (goal // by[s])
            rest = max(0, min(n, goal % by[s] - at))
            at += n
            if rest:
                out.append((r[0], r[1] if rest == n else " ".join(words(r[1])[:rest])))
    return out


def test_run_by_rule(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = small_table()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.withColumn("extra", F.lit("x")).withColumn("fp", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = kept_by_rule(rows)
    clean = {r["k"]: r["text"] for r in pii.replaced(spark.createDataFrame([(i, r[1]) for i, r in enumerate(kept)], "k int, text string"), ["k"]).collect()}
    kept = [(r[0], clean[i], *r[2:]) for i, r in enumerate(kept)]
    assert "jo.doe@site.org" not in str(kept) and "555-123-4567" not in str(kept)
    encode, want = Tokenizer.from_file(packing.default_tokenizer()).encode, Counter()
    for doc_id, text in mixed_by_rule(kept):
        ids = encode(text, add_special_tokens=False).ids + [1]
        for start, length in packing.cuts(len(ids)):
            want[(doc_id, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids))] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert got == want and sum(want.values()) > 40


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
