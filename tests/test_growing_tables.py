"""Tables that grow with the data stay away from the driver, and joins on them give the same rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vicinity.functions import similarity
from vicinity.functions.similarity import pairs_by_bound
from vicinity.operators import matching, search
from vicinity.session import cut


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_taken_apart_are_not_broadcast(spark, tmp_path):
    # 20,000 names of one letter pattern pack into files far below the threshold; their parts are many times the rows.
    names = spark.range(20_000).select(F.lit("k").alias("k"), F.concat(F.lit("단지마을"), (F.col("id") % 50).cast("string")).alias("x"), "id")
    left, right = cut(names), cut(names.select("k", F.col("x").alias("y"), F.col("id").alias("n")))
    assert "Broadcast" not in _plan(search.containment_join(left, right, "x", "y", ("k",), shortest=4))
    assert "Broadcast" not in _plan(pairs_by_bound(left.select("k", "x").distinct(), right.select("k", "y").distinct(), "x", "y", ("k",), 0.6, 2.0))


def test_containment_inside_keys_keeps_rows(spark):
    left = [("a", "나다라", 1), ("a", "나다라", 2), ("b", "나다라", 3), (None, "나다라", 4), ("a", "다", 5), ("b", None, 6)]
    right = [("a", "가나다라", 7), ("a", "나다라", 8), ("b", "다라", 9), ("a", "다라", 10), (None, "다라", 11), ("c", "다라", 12)]
    got = search.containment_join(
        spark.createDataFrame(left, "k string, x string, i long"), spark.createDataFrame(right, "k string, y string, j long"), "x", "y", ("k",), 2
    )
    assert got.columns == ["k", "x", "i", "y", "j"]
    want = [(1, 7), (1, 8), (1, 10), (2, 7), (2, 8), (2, 10), (3, 9)]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_blocks_of_the_lot_are_not_broadcast(spark):
    cand = "cand_name string, cand_road string, cand_jibun string, cand_norm string, cand_bonbun string, cand_bubun string, trade_count long, rent_count long, gu string, dong_norm string"
    cands = spark.createDataFrame([(f"가나다라{k}", "", "7", f"가나다라{k}", "7", "", k, 0, "구", "동") for k in range(12, 40)], cand)
    sites = spark.createDataFrame([(1, "나다라13호", "구", "동", "7", ""), (2, "가나다라2", "구", "동", "7", ""), (3, "가나다라14", "구", "동", "7", "")],
                                  "site_id long, name_norm string, gu string, dong_norm string, bonbun string, bubun string")
    by_lot = cands.withColumns({"bonbun": F.col("cand_bonbun"), "bubun": F.col("cand_bubun")})
    found = matching.block_branch(matching.written(sites), matching.written(by_lot), ("gu", "dong_norm", "bonbun", "bubun"), "gu_dong_jibun_exact", 2)
    assert "BroadcastHashJoin" not in _plan(found)
    got = {r["site_id"]: (r["_c"]["cand_name"], r["match_type"]) for r in found.collect()}
    assert got == {
        1: ("가나다라12", "gu_dong_jibun_exact_ambiguous"), 2: ("가나다라20", "gu_dong_jibun_exact_candidate"),
        3: ("가나다라14", "gu_dong_jibun_exact_name_confirmed"),
    }


def test_pairs_of_a_lot_are_not_shuffled(spark):
    sites = spark.createDataFrame(
        [(1, "가12", "구", "동", "7", ""), (2, "나", "구", "동", "7", ""), (3, "동다3", "구", "동", "7", ""), (3, "동다3", "구2", "동", "7", ""), (4, "라", "구", "동", None, "")],
        "site_id long, name_norm string, gu string, dong_norm string, bonbun string, bubun string",
    )
    rows = [("구", "동", "7", "", "동가012"), ("구", "동", "7", "", "동가012"), ("구", "동", "7", "", "가13"), ("구2", "동", "7", "", "가13"), ("구", "동", "8", "", "나")]
    cands = spark.createDataFrame(rows, "gu string, dong_norm string, cand_bonbun string, cand_bubun string, cand_norm string")
    found = matching.lot_evidence(sites, cands)
    want = {
        (1, "가12", "동가012", False, False, "가012"), (1, "가12", "가13", True, False, "가13"), (2, "나", "동가012", False, True, "가012"),
        (2, "나", "가13", False, True, "가13"), (3, "동다3", "동가012", True, False, "가012"), (3, "동다3", "가13", True, False, "가13"),
    }
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    # The pairs of sites with one row are made last: nothing is dealt out again above their join.
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "Union" in top and "Join Inner" in top


def test_pairs_that_can_be_the_best_are_found_without_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("가나다라마12") for _ in range(rng.randint(0, 8)))
    left, right = [("k" if n % 3 else "m", word()) for n in range(90)], [("k" if n % 4 else "m", word() + "라") for n in range(80)]
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    a, b = spark.createDataFrame(left, "k string, x string"), spark.createDataFrame(right, "k string, y string")
    for names, others in ((512, 4096), (7, 5)):
        monkeypatch.setattr(similarity, "_NAMES_AT_ONCE", names)
        monkeypatch.setattr(similarity, "_OTHERS_AT_ONCE", others)
        got = [tuple(r) for r in similarity.reachable_pairs(a, b, "x", "y", ("k",)).collect()]
        assert len(got) == len(set(got))
        every = {(k, x, y) for k, x in left for m, y in right if k == m}
        for k, x in set(left):
            best = max(ratio(x, y) for m, x2, y in every if (m, x2) == (k, x))
            assert {y for m, x2, y in every if (m, x2) == (k, x) and ratio(x, y) == best} <= {y for m, x2, y in got if (m, x2) == (k, x)}
        named = [g for g in got if g[1]]
        assert len(named) < len([e for e in every if e[1]]) / 2


def test_shared_road_address_takes_the_most_similar_then_most_deals(spark):
    cand = "cand_name string, cand_road string, cand_jibun string, cand_norm string, cand_bonbun string, cand_bubun string, trade_count long, rent_count long, gu string, road_norm string"
    rows = [("A", "r", "", "푸른마을", "", "", 1, 0, "구", "r"), ("B", "r", "", "푸른마을", "", "", 5, 0, "구", "r"), ("C", "r", "", "마을회관", "", "", 9, 0, "구", "r")]
    sites = spark.createDataFrame([(1, "구", "r", "푸른마을2"), (2, "구", "r", ""), (3, "구", "r", "xyz"), (4, "구", "r", "마을회관")],
                                  "site_id long, gu string, road_norm string, name_norm string")
    got = {r["site_id"]: (r["_c"]["cand_name"], r["match_type"][19:]) for r in matching.road_branch(sites, spark.createDataFrame(rows, cand)).collect()}
    assert got == {1: ("B", "score_verified"), 2: ("C", "score_verified"), 3: ("C", "score_verified"), 4: ("C", "name_confirmed")}
