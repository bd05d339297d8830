"""Text operators on rows that an earlier version lost or judged wrongly."""

import numpy as np

import corpus_pipeline
from vicinity.llm import boosting, exact, ngram_join, toxicity


def test_isotonic_is_constant_inside_a_block():
    margin = np.array([-6.0, -5.5, -5, -4, -3, -2, -1, 0])
    y = (margin >= -2).astype(float)
    fitted = boosting.Isotonic().fit(margin, y, np.ones(len(y)))
    assert fitted(np.array([-9.0, -6, -4.5, -3, -2.5, -2, 0, 3])).tolist() == [0, 0, 0, 0, 0.5, 1, 1, 1]
    rng = np.random.default_rng(5)
    margin, y, weight = rng.integers(0, 30, 200) / 3, rng.integers(0, 2, 200).astype(float), rng.uniform(0.5, 2, 200)
    at = np.unique(margin)
    t, w = (np.array([x[margin == m].sum() for m in at]) for x in (y * weight, weight))
    mean = lambda a, b: t[a : b + 1].sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    assert np.allclose(boosting.Isotonic().fit(margin, y, weight)(at), want)


def test_planted_clean_rows_survive_toxicity(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo") for c in ("n", "r", "s", "m")]
    text = lambda n: " ".join(rng.choice(word, n))
    rows = [(k, text(int(rng.integers(20, 200))) + (" you idiot, you stupid moron!" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    planted = spark.createDataFrame([(1000 + k, text(int(rng.integers(20, 200)))) for k in range(200)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs.unionByName(planted), str(tmp_path)).collect()}
    assert set(range(1000, 1200)) <= kept and not kept & set(range(0, 800, 4))


def test_exact_keeps_every_text(spark):
    rows = [
        (None, "first without id"), (None, "second without id"), (None, "second  without id"), (5, "one text of five"), (5, "other text of five"),
        (4, "shared"), (6, "shared"), (6, "own text of six"), (None, "shared"), (5, "one text of five"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _sha string")
    for n in (1, 4):
        kept = exact.drop_copies(docs.repartition(n))
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"] or 0), " ".join(r["text"].split())) for r in kept.collect())
        assert got == [
            (0, "first without id"), (0, "second without id"), (4, "shared"), (5, "one text of five"), (5, "other text of five"), (6, "own text of six"),
        ]


def test_near_duplicates_without_id(spark):
    base = [" ".join(f"g{g}w{k}" for k in range(60)) for g in range(4)]
    near = lambda g, k: f"{base[g]} end{k}"
    rows = [
        (None, near(0, 0)), (1, near(0, 1)), (2, near(0, 2)), (None, near(1, 0)), (3, near(1, 1)), (4, near(2, 0)), (5, near(2, 1)),
        (5, "a text of its own that shares its id with another row"), (6, near(3, 0)), (7, near(3, 1)), (None, "alone without id"), (8, ""), (9, None),
    ]
    kept = corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    want = [r for r in rows if r not in [(1, near(0, 1)), (2, near(0, 2)), (3, near(1, 1)), (5, near(2, 1)), (7, near(3, 1))]]
    assert kept.columns == ["doc_id", "text"] and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_every_similar_pair_meets():
    """Two sets alone, whose blocks are often empty, share as many leaves as each needs in one of its bands."""
    rng = np.random.default_rng(2)
    np.seterr(over="ignore")
    for percent in (50, 60, 74, 75, 80, 90):
        for _ in range(1500):
            small = int(rng.integers(1, 30))
            large = rng.integers(0, 1 << 63, small * 100 // percent, dtype=np.uint64)
            own = [np.sort(large), np.sort(large[:small])]
            found = [ngram_join._searched(x, percent, 1) for x in own]
            met = [(len(np.intersect1d(x, y)), n, m) for x, n in found[0] for y, m in found[1]]
            assert any(k >= max(1, n, m) for k, n, m in met), (percent, small)
    bands = [ngram_join._band(n) for n in range(1, 5001)]
    for percent in range(50, 101):
        assert max(bands[n - 1] - bands[-(-n * percent // 100) - 1] for n in range(1, 5001)) < ngram_join._roles(percent)
