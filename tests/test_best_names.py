"""The best candidate name of a site, whatever its similarity, against brute force."""

import random
from difflib import SequenceMatcher

from vicinity.operators import matching


def test_best_names_without_threshold(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("가나다라마바사아자차카타파하abc12") for _ in range(rng.randint(1, 9)))
    sites = [(k, "구", f"동{k % 3}", "7" if k % 4 == 0 else None, "", word()) for k in range(60)]
    sites += [(60, "구", "동0", None, "", "쀍"), (61, "구", "동9", None, "", "가나"), (62, "구", "동1", None, "", "")]
    cands = [(f"n{k}", None, None, word(), "7" if k % 5 == 0 else "", "", k, 0, "구", f"동{k % 3}") for k in range(40)]
    want = {}
    for i, gu, dong, bonbun, bubun, name in sites:
        own = [c for c in cands if (c[8], c[9]) == (gu, dong)]
        own = [c for c in own if bonbun and (c[4], c[5]) == (bonbun, bubun)] or own
        found = [(SequenceMatcher(None, name, c[3]).ratio(), c[6], c[0]) for c in own if name and c[3]]
        if found and max(found)[0] > 0:
            want[i] = max(found)[::2]
    assert sum(s < 0.3 for s, _ in want.values()) > 3 and sum(s >= 0.5 for s, _ in want.values()) > 3 and 60 not in want
    left = spark.createDataFrame(sites, "site_id long, gu string, dong_norm string, bonbun string, bubun string, name_norm string")
    kinds = "cand_name string, cand_road string, cand_jibun string, cand_norm string, cand_bonbun string, cand_bubun string, trade_count long, rent_count long, gu string, dong_norm string"
    got = matching.best_names(left, spark.createDataFrame(cands, kinds)).collect()
    assert len(got) == len(want) and {r["site_id"]: (r["best_similarity"], r["best"]["cand_name"]) for r in got} == want
