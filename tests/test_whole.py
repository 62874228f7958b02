"""Queries do the whole job: results on small fixtures against brute force."""

from collections import Counter
from fractions import Fraction

import duckdb

from quarry.plans import catalog


def test_structural_diff_compares_every_file(spark, tmp_path):
    ids = range(295, 335)
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {
        "renamed": sum(i % 10 == 1 for i in ids),
        "body_changed": sum(2 for i in ids if i % 10 == 3 and i % 3 == 0),
        "deleted": sum(3 if i % 3 == 2 else 4 for i in ids if i % 10 == 9),
    }
    got = {r["change"]: r["n"] for r in catalog.QUERIES["structural_diff"](spark, str(tmp_path)).collect()}
    assert got == want


def fnv12(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h & 4095


def test_fnv_line_hash_covers_long_lines(spark, tmp_path):
    lines = ["short", "", "x" * 60, "y" * 61, "é€😀\0\x7f\x80ÿ " * 50, "Zeile mit Wörtern " * 8000]
    spark.createDataFrame([(5, "\n".join(lines) + "\n", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line"]: (r["hash"], r["anchor"]) for r in catalog.QUERIES["fnv_line_hash"](spark, str(tmp_path)).collect()}
    assert got == {n: (fnv12(t), f"{n}:{fnv12(t):03x}") for n, t in enumerate(lines, 1)}


def dice(a, b):
    pairs = lambda t: [s[i : i + 2] for s in ["".join(t.split())] for i in range(len(s) - 1)]
    x, y = pairs(a), pairs(b)
    rest, shared = list(y), 0
    for g in x:
        if g in rest:
            rest.remove(g)
            shared += 1
    return round(2 * shared / (len(x) + len(y)), 6)


def test_fuzzy_pairs_dice_scores_whole_texts(spark, tmp_path):
    head = "The same first words begin every text of this small fixture, "
    items = {1: head + "and then it goes on about rivers.", 2: head + "but here come ships and harbours!", 3: "0123456789" * 9}
    docs = {10: head + "and then it goes on about rivers.", 11: head + "wobei hier Schiffe, Häfen kommen.", 12: "abcdefgh " * 10, 13: head}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda t: len(t.encode())
    want = {(i, d): dice(x, y) for i, x in items.items() for d, y in docs.items() if min(size(x), size(y)) >= 0.8 * max(size(x), size(y))}
    assert want[1, 10] == 1 and want[3, 12] == 0
    got = {(r["a"], r["b"]): r["score"] for r in catalog.QUERIES["fuzzy_pairs_dice"](spark, str(tmp_path)).collect()}
    assert got == want


def test_symbol_search_returns_every_match(spark, tmp_path):
    spark.range(7400).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    suffix, call = {0: "src/m{}.py", 1: "src/m{}.rs", 2: "web/m{}.js"}, {0: 5, 1: 5, 2: 4}
    want = [("web/m5.js", 7, True)] + [(suffix[i % 3].format(i), call[i % 3], False) for i in range(5, 7400, 7)]
    assert len(want) > 1000
    got = [(r["path"], r["line"], r["is_definition"]) for r in catalog.QUERIES["symbol_search"](spark, str(tmp_path)).collect()]
    assert got == want[:1] + sorted(want[1:])


def test_recency_buckets_round_to_seconds(spark, tmp_path):
    limits, day = {3600: 100, 86400: 80, 604800: 50, 2592000: 20}, 1_704_067_200
    for now in (261_702, 500_000, 750_000, 1_500_000):
        folder, fractions = f"{tmp_path}/{now}", (0, 1, 499_999, 500_000, 500_001, 999_999)
        times = [day * 1_000_000 + now] + [(day - limit + s) * 1_000_000 + f for limit in limits for s in (-1, 0, 1, 2) for f in fractions]
        spark.createDataFrame([(t,) for t in times], "us long").selectExpr("CAST(timestamp_micros(us) AS timestamp_ntz) AS ts").write.parquet(f"{folder}/events.parquet")
        whole = [round(Fraction(t, 1_000_000)) for t in times]  # halves to even
        want = Counter(next((points for limit, points in limits.items() if whole[0] - t < limit), 0) for t in whole)
        got = {r["points"]: r["n"] for r in catalog.QUERIES["recency_buckets"](spark, folder).collect()}
        sql = catalog.ORACLE_SQL["recency_buckets"].replace("FROM events", f"FROM '{folder}/events.parquet/*.parquet'")
        assert got == dict(duckdb.sql(sql).fetchall()) == want
