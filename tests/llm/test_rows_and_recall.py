"""Rows without id in the pipeline, frequent leaks, and large groups of near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vicinity.llm import decontaminate, ngram_join, sharding

ITEM = " ".join(f"secret{k}" for k in range(20))


def bench(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_only_the_contaminated_row_goes(spark, tmp_path):
    folder = bench(spark, tmp_path, [(1, ITEM)])
    rows = [(None, f"lead {ITEM} tail"), (None, "clean without id"), (8, ITEM), (8, "clean with a shared id"), (7, "clean"), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, x, 1, "k", "f") for i, x in rows], "doc_id long, text string, _row int, key string, found string")
    left = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=repr)


def test_near_copies_of_rows_without_id(spark):
    base = [f"w{k}" for k in range(120)]
    near = " ".join([*base[:-1], "other"])
    rows = [(None, " ".join(base)), (3, near), (3, "another text with the same id"), (None, "text without id"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, _row int, stays int")
    left = corpus_pipeline.drop_near(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)


def test_a_leak_in_very_many_documents_is_found_in_all(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four five")], "item_id long, text string")
    docs = [(k, f"x{k} alpha beta gamma y{k}") for k in range(1000)] + [(2000 + k, f"x{k} one two three y{k} z{k}") for k in range(60)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 1 and r["score"] == 1.0} == set(range(1000))
    assert {r["doc_id"] for r in got if r["item_id"] == 2} == set(range(2000, 2060))


def edited(rng, words):
    out = []
    for w in words:
        kind = rng.random()
        if kind < 0.08:
            continue
        out.append(f"new{rng.randrange(10**6)}" if kind < 0.2 else w)
        if kind > 0.95:
            out.append(f"add{rng.randrange(10**6)}")
    return out


def test_recall_of_edited_copies_against_aligning_every_pair(spark):
    """Every document against every item, without a seed; frequent seeds by many copies of every item."""
    rng = random.Random(12)
    items = [[f"i{rng.randrange(400)}" for _ in range(rng.randint(6, 40))] for _ in range(12)]
    docs = []
    for k in range(360):
        text = [f"d{rng.randrange(3000)}" for _ in range(rng.randint(5, 60))]
        at = rng.randint(0, len(text))
        docs.append(text[:at] + edited(rng, items[k % 12]) + text[at:])
    number = {w: np.uint64(n) for n, w in enumerate({w for x in docs + items for w in x})}
    code = lambda words: np.array([number[w] for w in words], np.uint64)
    want = set()
    for j, item in enumerate(items):
        for a in range(0, len(docs), 60):
            part = docs[a : a + 60]
            scores = decontaminate.smith_waterman([code(x) for x in part], [code(item)] * len(part))
            want |= {(a + k, j) for k, (s, _, _) in enumerate(scores) if s >= len(item)}
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, t).collect()}
    assert got <= want and len(want) > 200
    assert len(got) >= 0.97 * len(want)


def test_a_group_of_3000_near_copies(spark):
    n = 3000
    base = F.array(*(F.lit(f"w{k}") for k in range(150)))
    at = F.col("id") % 140 + 1
    words = F.transform(base, lambda w, k: F.when(k == at, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).otherwise(w))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    others = spark.range(n, n + 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("alone "), F.col("id").cast("string"), F.lit(" a b c d")).alias("text"))
    got = ngram_join.jaccard_components(docs.unionByName(others)).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 50 + [n]


def test_shards_keep_columns_with_any_name(spark, tmp_path):
    names = ["doc_id", "text", "_h", "_entry", "_load", "depth", "c0", "shard", "a b"]
    rows = [(k, "x" * (k % 50), k, k, k, k, k, "old", k) for k in range(300)]
    docs = spark.createDataFrame(rows, names).repartition(3)
    placed = sharding.shard(docs, 500)
    assert set(placed.columns) == {*names, "shard_depth", "shard_row_bytes"}
    got = placed.collect()
    assert len(got) == 300 and all(r["_h"] == r["_entry"] == r["depth"] == r["c0"] == r["a b"] == r["doc_id"] for r in got)
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["shard_row_bytes"]
    assert len(load) > 8 and max(load.values()) <= 500 and "old" not in load
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 500)
    written = spark.read.option("basePath", str(tmp_path / "out")).schema("doc_id long, text string, shard_depth long, shard_row_bytes long, shard string").parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"]) for r in written.collect()} == {(r["doc_id"], r["shard"]) for r in got}
