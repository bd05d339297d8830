"""Operators on texts: against SQL, brute force, other encoders, and held-out labels; and on awkward tables."""

import hashlib
import os
import re

import numpy as np
import pytest
from check_queries import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from vicinity.llm import bpe, catalog, decontaminate, exact, language, lines, ngram_join, quality, sharding, substring, toxicity

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, id string, n long, depth int, rep string"
LONG = " ".join(f"w{k}" for k in range(30000))
RUN = " ".join(f"run{k}" for k in range(40))
AWKWARD = [
    (1, None, "en", None, "x", 1, 1, "y"), (2, "", None, "s", "x", 1, 1, "y"), (3, "  \n\t ", "en", "s", None, 1, None, "y"),
    (4, LONG, "en", "s", "x", 1, 1, None), (5, LONG, "en", "s", "x", 1, 1, "y"), (5, LONG, "en", "s", "x", 1, 1, "y"),
    (None, "no id here", "en", "s", "x", 1, 1, "y"), (6, "one", "de", "s", "x", 1, 1, "y"), (7, "lead " + RUN, "de", "s", "x", 1, 1, "y"),
    (8, RUN + " tail", "de", "s", "x", 1, 1, "y"), (9, "you IDIOT!! st*pid", "en", "s", "x", 1, 1, "y"),
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert difference(df, duck, catalog.ORACLES[name]) is None
    elif name != "op2_decontamination":
        assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_substring(awkward, empty):
    out = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(awkward).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 30000, 0), (5, 30000, 30000), (None, 3, 0), (6, 1, 0), (7, 41, 0), (8, 41, 40)} <= out
    assert substring.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(empty, window=10, block=10)


def test_spans_are_maximal(spark):
    docs = spark.createDataFrame([(1, RUN), (2, f"a {RUN} b {RUN}")], "doc_id long, text string")
    row = substring.remove_repeats(docs).where("doc_id = 2").first()
    assert [tuple(s) for s in row["spans"]] == [(1, 41), (42, 82)] and row["kept_text"] == "a b"


def test_exact(awkward, empty):
    rows = exact.copies(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] in (1, 2, 3, 5)} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (5, 4, 3)}
    kept = exact.drop_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8, 9]
    assert exact.copies(empty).count() == 0


def test_lines(spark, awkward, empty):
    line = "A line that is long enough to count"
    docs = spark.createDataFrame([(k, f"{'  ' * k}{line}\nown {k}\n{line.upper()}") for k in range(1, 5)] + [(None, line)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_lines(docs).collect()}
    assert out[1] == (3, 2, "own 1") and out[4][1] == 0 and out[None] == (1, 1, "")
    assert {(r["doc_id"], r["n_lines"]) for r in lines.drop_lines(awkward).collect()} >= {(1, 1), (2, 1), (3, 2)}
    assert lines.drop_lines(empty).count() == 0


def test_runs_merge(spark):
    runs = lines.Runs(spark, shares=3)
    batch = lambda *rows: spark.createDataFrame([(bytearray(k, "ascii"), i) for k, i in rows], "key binary, id long")
    assert runs.add(batch(("a", 1), ("b", 2))).count() == 2
    assert [bytes(r["key"]) for r in runs.add(batch(("a", 5), ("c", 6))).collect()] == [b"c"]
    assert runs.add(batch(("a", 3), ("c", 9))).count() == 0
    assert {(bytes(r["key"]), r["n"], r["last"]) for r in runs.merged().collect()} == {(b"a", 3, 5), (b"b", 1, 2), (b"c", 2, 9)}


def test_sharding(spark, awkward, empty):
    out = sharding.shard(awkward, 1000)
    assert out.count() == len(AWKWARD) and set(awkward.columns) <= set(out.columns)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"))
    loads = sharding.shard(many, 500).groupBy("shard").agg(F.sum("shard_row_bytes").alias("load")).collect()
    assert max(r["load"] for r in loads) <= 500 and sum(r["load"] for r in loads) == 30000
    names = sorted(r["shard"] for r in loads)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.shard(empty, 10).count() == 0


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (3, 60)])
def test_jaccard_components(spark, size, percent):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 400, rng.integers(4, 160))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.integers(0, 9)):
                own[rng.integers(len(own))] = f"z{rng.integers(1 << 30)}"
            texts.append(" ".join(own))
    texts += ["", None, "a b", "A  b", "a"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, size=size, percent=percent).collect()}
    assert out == {k: (len(sets[k]), root[k]) for k in range(len(texts))}


def test_jaccard_awkward(awkward, empty):
    out = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(awkward).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, None), (7, 7), (8, 7)} == out - {(6, 6), (9, 9)}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_bpe(spark, awkward, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = awkward.unionByName(spark.createDataFrame([(20, "naïve 東京\u0085 <|endoftext|>   \r\n x" + "=" * 3000)], "doc_id long, text string"), True)
    out = bpe.encode(docs, path, P.PATTERN).withColumnRenamed("decoded", "first").cache()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = {(k, np.array(other.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in texts}
    assert {(r["doc_id"], bytes(r["token_ids"]), bytes(r["first"])) for r in out.collect()} == want
    assert {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(out, path).collect()} == {(k, x) for k, _, x in want}
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def _align(p, q):
    best, row = 0, [0] * (len(p) + 1)
    for y in q:
        new = [0]
        for j, x in enumerate(p, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_smith_waterman():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))) for _ in range(60)]
    got = decontaminate.smith_waterman([p.astype(np.uint64) for p, _ in pairs], [q.astype(np.uint64) for _, q in pairs])
    for (p, q), (score, begin, end) in zip(pairs, got):
        assert score == _align(p.tolist(), q.tolist()) == _align(p[begin:end].tolist(), q.tolist())


def test_contaminated(spark, awkward, empty):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tests = {r["item_id"]: words(r["text"]) for r in items.collect()}
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for item, q in tests.items():
            if sum(tuple(q[k : k + 3]) in grams for k in range(len(q) - 2)) > 1 and _align(w, q) >= len(q):
                want.add((r["doc_id"], item))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == want
    edited = RUN.replace("run7 ", "").replace("run20", "other").split()
    test = spark.createDataFrame([(1, " ".join(edited)), (2, ""), (3, None), (4, "One")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(awkward, test).collect()}
    assert set(got) == {(7, 1), (8, 1), (6, 4)} and 0.9 < got[(7, 1)] < 1
    assert decontaminate.contaminated(empty, test).count() == 0 and decontaminate.contaminated(awkward, test.limit(0)).count() == 0


def test_classifiers_on_awkward_tables(spark, awkward, empty):
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for given in (labels, labels.limit(0)):
            rows = module.score(awkward, module.fit(awkward, given)).collect()
            assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(empty, module.fit(empty, labels)).count() == 0
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(awkward, language.fit(awkward)).collect()}
    assert out[1] == out[2] == out[3] == "und" and out[4] in ("en", "de")
    assert {r["lang_pred"] for r in language.predict(awkward, language.fit(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = catalog.op3_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    for query, label in ((catalog.op4_toxicity, "toxic"), (catalog.op10_quality, "quality")):
        right = query(spark, folder).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")))
        assert right.first()[0] > 0.85


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    no_toxic = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert no_toxic.columns == docs.columns
    unique = corpus_pipeline.drop_exact(spark, docs, FOLDER)
    plain = {}
    for r in docs.collect():
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).digest()
        plain[key] = min(plain.get(key, r["doc_id"]), r["doc_id"])
    assert ids(unique) == set(plain.values())
    tokens = {r["doc_id"]: (r["text"] or "").lower().split() for r in unique.collect()}
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, w in tokens.items()}
    near = {a for a in sets for b in sets if b < a and _jaccard(sets[a], sets[b]) >= 0.8}
    assert ids(corpus_pipeline.drop_near(spark, unique, FOLDER)) >= set(sets) - near
    final = corpus_pipeline.run(spark, FOLDER)
    assert 0 < final.count() <= no_toxic.count() and "token_ids" in final.columns
