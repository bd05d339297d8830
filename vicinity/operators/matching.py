"""Entity resolution: which recorded name and address of the deals belongs to which site.

Sites and candidates meet through equi-joins only: on road address, road number, lot, name and,
for containment, on substrings of the name. Inside a block only what decides is computed (its
size, its first row, an equal name), so a crowded block never yields all its pairs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geo import half_even
from ..functions.similarity import pairs_by_bound, reachable_pairs, similarity, with_letters
from ..session import cut, spread
from .search import containment_join

# Confidences (verified, candidate) per branch, and the thresholds.
BRANCHES = {
    "road_address_exact": (0.98, 0.86),
    "gu_dong_road_number_exact": (0.97, 0.82),
    "gu_dong_jibun_exact": (0.96, 0.80),
}
NAME_CONFIRMED, NAME_CANDIDATE, CONTAINED = 0.94, 0.72, 0.78
ALIAS_THRESHOLD = 0.92
QUICK_REVIEW = (0.80, 0.92)
NAME_RELATED = 0.72
#: Lower ends of the rounds in which the best name is looked for, by the bound of a pair; the last is any shared letter.
NAME_BOUNDS = (0.85, 0.6, 0.35, 1e-6)
RISK_CEILING = 0.60
APPROVE_REVIEW = 0.78
LINEAGE_SIMILARITY = 0.86

_CANDIDATE = ["cand_name", "cand_road", "cand_jibun", "cand_norm", "cand_bonbun", "cand_bubun", "trade_count", "rent_count"]


def prepare_sites(sites: DataFrame) -> DataFrame:
    """Adds the matching keys: ``name_norm, dong_norm, road_norm, road_name_norm, detail_norm``."""
    return sites.select(
        "site_id", "name", "gu", "dong", "road_address", "is_rental",
        tx.normalize_name("name").alias("name_norm"),
        tx.normalize_dong("dong").alias("dong_norm"),
        tx.normalize_address("road_address").alias("road_norm"),
        tx.normalize_address("road_name").alias("road_name_norm"),
        tx.normalize_address("road_detail").alias("detail_norm"),
        tx.lot_part("bonbun").alias("bonbun"),
        F.coalesce(tx.lot_part("bubun"), F.lit("")).alias("bubun"),
    )


def candidates(deals: DataFrame) -> DataFrame:
    """Distinct recorded complexes with their deal counts.

    ``deals``: ``apartment_name, gu, dong, road_name, road_address, bonbun, bubun,
    transaction_type``. Spellings of one key keep the smallest text. Deals are counted per spelling
    first: only distinct spellings are normalised.
    """
    raw = ["gu", "dong", "apartment_name", "road_address", "road_name", "bonbun", "bubun"]
    spelled = deals.groupBy(*raw).agg(
        F.count_if(F.col("transaction_type") == "trade").alias("trades"),
        F.count_if(F.col("transaction_type") == "rent").alias("rents"),
    )
    keyed = spelled.where(tx.clean("apartment_name").isNotNull()).select(
        "gu", "apartment_name", "road_address", "trades", "rents",
        tx.normalize_dong("dong").alias("dong_norm"),
        tx.normalize_name("apartment_name").alias("cand_norm"),
        tx.normalize_address("road_address").alias("road_norm"),
        tx.normalize_address("road_name").alias("cand_road_name_norm"),
        F.coalesce(tx.lot_part("bonbun"), F.lit("")).alias("cand_bonbun"),
        F.coalesce(tx.lot_part("bubun"), F.lit("")).alias("cand_bubun"),
    )
    rolled = keyed.groupBy("gu", "dong_norm", "cand_norm", "road_norm", "cand_bonbun", "cand_bubun").agg(
        F.min("apartment_name").alias("cand_name"),
        F.min("road_address").alias("cand_road"),
        F.min("cand_road_name_norm").alias("cand_road_name_norm"),
        F.sum("trades").alias("trade_count"),
        F.sum("rents").alias("rent_count"),
    )
    return rolled.withColumn(
        "cand_jibun", F.coalesce(tx.compose_lot("cand_bonbun", "cand_bubun"), F.lit(""))
    )


def written(df: DataFrame) -> DataFrame:
    """Sites, names and lots all grow with the data: no join of the chain goes through the driver."""
    return spread(cut(df))


def _first() -> Column:
    """The candidate that comes first (by name, road, lot)."""
    return F.struct(*_CANDIDATE)


def _rows(df: DataFrame, match_type, confidence, verified: str, priority: int) -> DataFrame:
    return df.select(
        "site_id",
        F.lit(priority).alias("priority"),
        "_c",
        (match_type if isinstance(match_type, Column) else F.lit(match_type)).alias("match_type"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("match_confidence"),
        F.lit(verified).alias("verified"),
    )


def road_branch(sites: DataFrame, cands: DataFrame, priority: int = 0) -> DataFrame:
    """Equal road address: the best by similarity, then deals, then name.

    An equal name has similarity 1 and wins outright; of the other sites of a shared address only
    pairs that can be the best are measured, and folded by partial maximum.
    """
    high, low = BRANCHES["road_address_exact"]
    named = sites.where("road_norm <> ''").select("site_id", "gu", "road_norm", "name_norm")
    found = cands.where("road_norm <> ''")
    blocks = found.groupBy("gu", "road_norm").agg(F.count("*").alias("_n"), F.min(_first()).alias("_one"))
    located = named.join(blocks, ["gu", "road_norm"])
    single = located.where("_n = 1").withColumn("_c", F.col("_one"))
    shared = located.where("_n > 1").drop("_one")
    rank = lambda sim: F.struct(
        sim.alias("sim"), (F.col("trade_count") + F.col("rent_count")).alias("deals"), *_CANDIDATE
    )
    equal = (
        shared.join(found.withColumn("name_norm", F.col("cand_norm")), ["gu", "road_norm", "name_norm"])
        .groupBy("site_id")
        .agg(F.max(rank(F.lit(1.0))).alias("_b"))
    )
    rest = shared.join(equal.select("site_id"), "site_id", "left_anti")
    # The pair with the most letters in common is measured first; only pairs that can reach it are measured then.
    at = ["gu", "road_norm", "name_norm"]
    pairs = reachable_pairs(rest.select(*at), found, "name_norm", "cand_norm", at[:2])
    # Of equal names at an address only the one of most deals can be the best.
    one = found.groupBy("gu", "road_norm", "cand_norm").agg(F.max(rank(F.lit(0.0))).alias("_one"))
    fields = ["deals", *_CANDIDATE]
    ranked = F.struct(similarity("name_norm", "cand_norm").alias("sim"), *[F.col(f"_one.{c}").alias(c) for c in fields])
    measured = spread(pairs).join(one, [*at[:2], "cand_norm"]).groupBy(*at).agg(F.max(ranked).alias("_b"))
    best = rest.join(measured, ["gu", "road_norm", "name_norm"]).select("site_id", "_b")
    pick = lambda df: df.withColumn("_c", F.struct(*[F.col(f"_b.{c}").alias(c) for c in _CANDIDATE]))
    kind = "road_address_exact"
    return (
        _rows(single, kind, high, "Y", priority)
        .unionByName(_rows(pick(equal), f"{kind}_name_confirmed", low, "Y", priority))
        .unionByName(_rows(pick(best), f"{kind}_score_verified", low, "Y", priority))
    )


def block_branch(
    sites: DataFrame, cands: DataFrame, keys: tuple[str, ...], kind: str, priority: int
) -> DataFrame:
    """A block key with a unique, name-confirmed, contained or ambiguous candidate."""
    high, low = BRANCHES[kind]
    located = sites.select("site_id", "name_norm", *keys)
    blocks = cands.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(_first()).alias("_one"))
    inside = located.join(blocks, list(keys)).withColumn("_c", F.col("_one"))
    unique, crowded = inside.where("_n = 1"), inside.where("_n > 1")
    equal = (
        crowded.select("site_id", "name_norm", *keys)
        .join(cands.withColumn("name_norm", F.col("cand_norm")), [*keys, "name_norm"])
        .groupBy("site_id")
        .agg(F.min(_first()).alias("_c"))
    )
    rest = written(crowded.join(equal.select("site_id"), "site_id", "left_anti"))
    # Of equal names in a block only the first can be the one.
    beside = cands.join(rest.select(*keys).distinct(), list(keys), "left_semi")
    beside = beside.groupBy(*keys, "cand_norm").agg(F.min(_first()).alias("_c"))
    held = (
        containment_join(
            rest.select("site_id", "name_norm", *keys), beside, "name_norm", "cand_norm", keys, shortest=4
        )
        .groupBy("site_id")
        .agg(F.min("_c").alias("_c"))
    )
    unclear = rest.join(held.select("site_id"), "site_id", "left_anti")
    return (
        _rows(unique, kind, high, "Y", priority)
        .unionByName(_rows(equal, f"{kind}_name_confirmed", high, "Y", priority))
        .unionByName(_rows(held, f"{kind}_candidate", low, "N", priority))
        .unionByName(_rows(unclear, f"{kind}_ambiguous", low, "N", priority))
    )


def name_branch(sites: DataFrame, cands: DataFrame, priority: int) -> DataFrame:
    """Equal name in the same neighbourhood; the last candidate stands for the name."""
    named = sites.where("name_norm <> ''")
    last = cands.groupBy("gu", "dong_norm", "cand_norm").agg(F.max(_first()).alias("_c"))
    hit = named.join(last.withColumnRenamed("cand_norm", "name_norm"), ["gu", "dong_norm", "name_norm"])
    sure = address_validated("_c.cand_road", "_c.cand_bonbun", "_c.cand_bubun")
    kind = F.when(sure, "gu_dong_name_exact_address_confirmed").otherwise("gu_dong_name_exact_candidate")
    out = _rows(hit, kind, F.when(sure, NAME_CONFIRMED).otherwise(NAME_CANDIDATE), "N", priority)
    confirmed = F.col("match_type") == "gu_dong_name_exact_address_confirmed"
    return out.withColumn("verified", F.when(confirmed, "Y").otherwise("N"))


def contains_branch(sites: DataFrame, cands: DataFrame, priority: int) -> DataFrame:
    """One name inside the other (four letters at least) in the same neighbourhood."""
    names = cands.groupBy("gu", "dong_norm", "cand_norm").agg(F.min(_first()).alias("_c"))
    held = containment_join(
        sites.select("site_id", "gu", "dong_norm", "name_norm"), names, "name_norm", "cand_norm",
        ("gu", "dong_norm"), shortest=4,
    )
    first = held.groupBy("site_id").agg(F.min("_c").alias("_c"))
    return _rows(first, "same_dong_contains_candidate", CONTAINED, "N", priority)


def road_matches(cand_road) -> Column:
    own = F.col("road_norm")
    return F.coalesce((own != "") & (own == tx.normalize_address(cand_road)), F.lit(False))


def lot_matches(cand_bonbun, cand_bubun) -> Column:
    return F.coalesce(
        (F.col("bonbun") == F.col(cand_bonbun)) & (F.col("bubun") == F.col(cand_bubun)), F.lit(False)
    )


def address_validated(cand_road, cand_bonbun, cand_bubun) -> Column:
    return road_matches(cand_road) | lot_matches(cand_bonbun, cand_bubun)


def cascade(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """The first branch that finds anything decides; sites without one are ``unmatched``.

    A branch looks only at the sites that those before it left.

    ``sites`` from ``prepare_sites``, ``cands`` from ``candidates``.
    """
    by_lot = cands.where("cand_bonbun <> ''").withColumns(
        {"bonbun": F.col("cand_bonbun"), "bubun": F.col("cand_bubun")}
    )
    by_number = cands.where("cand_road_name_norm <> '' AND cand_jibun <> ''").withColumns(
        {
            "road_name_norm": F.col("cand_road_name_norm"),
            "detail_norm": F.regexp_replace("cand_jibun", "[^0-9]", ""),
        }
    )
    branches = [
        lambda left: road_branch(left, cands, 0),
        lambda left: block_branch(
            left.where("road_name_norm <> '' AND detail_norm <> ''"), by_number,
            ("gu", "dong_norm", "road_name_norm", "detail_norm"), "gu_dong_road_number_exact", 1,
        ),
        lambda left: block_branch(
            left.where("bonbun IS NOT NULL"), by_lot, ("gu", "dong_norm", "bonbun", "bubun"), "gu_dong_jibun_exact", 2
        ),
        lambda left: name_branch(left, cands, 3),
        lambda left: contains_branch(left, cands, 4),
    ]
    left, settled = sites, []
    for branch in branches:
        settled.append(written(branch(left)))
        left = left.join(settled[-1].select("site_id"), "site_id", "left_anti")
    merged = reduce(DataFrame.unionByName, settled)
    best = merged.select("site_id", F.struct("_c", "match_type", "match_confidence", "verified").alias("_m"))
    chosen = sites.join(best, "site_id", "left")
    return chosen.select(
        *[c for c in sites.columns],
        *[F.col(f"_m._c.{c}").alias(c) for c in _CANDIDATE],
        F.coalesce("_m.match_type", F.lit("unmatched")).alias("match_type"),
        F.coalesce("_m.match_confidence", F.lit(0.0)).alias("match_confidence"),
        F.coalesce("_m.verified", F.lit("N")).alias("verified"),
    )


def lot_blocks(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """Per site: how many candidates share its lot, and the first of them."""
    blocks = (
        cands.where("cand_bonbun <> ''")
        .groupBy("gu", "dong_norm", F.col("cand_bonbun").alias("bonbun"), F.col("cand_bubun").alias("bubun"))
        .agg(F.count("*").alias("lot_count"), F.min(_first()).alias("lot_first"))
    )
    return sites.select("site_id", "gu", "dong_norm", "bonbun", "bubun").join(
        blocks, ["gu", "dong_norm", "bonbun", "bubun"]
    ).select("site_id", "lot_count", "lot_first")


def lot_evidence(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """Every site with every name on its lot: numbers that disagree or that one name lacks, and the name without its dong.

    What belongs to one name is found once for it. Names are made distinct before they meet, so pairs are not shuffled;
    only sites with several rows on lots are, as their pairs may repeat.
    """
    keys = ["gu", "dong_norm", "bonbun", "bubun"]
    lots = cands.select("gu", "dong_norm", F.col("cand_bonbun").alias("bonbun"), F.col("cand_bubun").alias("bubun"), "cand_norm").distinct()
    names = lots.withColumns({"_numbers": tx.number_tokens("cand_norm"), "stripped": tx.strip_dong("cand_norm", "dong_norm")})
    own = sites.select("site_id", "name_norm", *keys).where(" AND ".join(f"{c} IS NOT NULL" for c in keys)).distinct()
    often = own.groupBy("site_id").agg(F.count("*").alias("_n")).where("_n > 1").select("site_id")
    columns = ["site_id", "name_norm", "cand_norm", "conflict", "asymmetry", "stripped"]

    def paired(some: DataFrame) -> DataFrame:
        met = spread(some.withColumn("_own", tx.number_tokens("name_norm"))).join(spread(names), keys)
        found = {"conflict": tx.tokens_conflict("_own", "_numbers"), "asymmetry": tx.tokens_asymmetry("_own", "_numbers")}
        return met.withColumns(found).select(*columns, "dong_norm")

    once = paired(own.join(often, "site_id", "left_anti"))
    return once.unionByName(paired(own.join(often, "site_id", "left_semi")).distinct()).select(columns)


def alias_approvals(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """Aliases safe enough to approve unseen.

    One candidate on the lot, a different but nearly equal name, deals on record, no numbers that
    disagree, more than a brand name left, and no mere neighbourhood prefix. (The same check on a
    contained name of the neighbourhood needs an equal lot, which the lot branch has by then
    decided, so it adds no row.)
    """
    single = lot_blocks(sites, cands).where("lot_count = 1")
    both = sites.join(single, "site_id").select(
        "site_id", "name_norm", "dong_norm", "dong", *[F.col(f"lot_first.{c}").alias(c) for c in _CANDIDATE]
    )
    dong_name = tx.normalize_name("dong")
    plausible = (
        (F.col("name_norm") != F.col("cand_norm"))
        & (F.col("trade_count") + F.col("rent_count") > 0)
        & ~tx.number_conflict("name_norm", "cand_norm")
        & ~tx.only_generic("name_norm", "cand_norm")
        & (tx.strip_dong(F.col("name_norm"), dong_name) != F.col("cand_norm"))
    )
    scored = both.where(plausible).withColumn("similarity", similarity("name_norm", "cand_norm"))
    return scored.where(F.col("similarity") >= ALIAS_THRESHOLD)


def match_sites(
    sites: DataFrame, cands: DataFrame, overrides: DataFrame | None = None, rejects: DataFrame | None = None
) -> DataFrame:
    """The mapping: overrides, then approved aliases, then the cascade; rejects, tenure and risk last.

    ``overrides``: ``site_id, cand_name, cand_road, cand_jibun``; ``rejects``: ``site_id, cand_name``.
    Give written tables: they are read by every branch. The cascade is written before the rest.
    """
    base = written(cascade(sites, cands))
    alias = alias_approvals(sites, cands).select(
        "site_id", F.struct(*_CANDIDATE).alias("_alias"), half_even("similarity", 2).alias("_score")
    )
    rows = base.join(alias, "site_id", "left")
    use = F.col("_alias").isNotNull()
    rows = rows.withColumns(
        {
            **{c: F.when(use, F.col(f"_alias.{c}")).otherwise(F.col(c)) for c in _CANDIDATE},
            "match_type": F.when(use, "AUTO_APPROVE_ALIAS").otherwise(F.col("match_type")),
            "match_confidence": F.when(use, F.col("_score")).otherwise(F.col("match_confidence")),
            "verified": F.when(use, "Y").otherwise(F.col("verified")),
        }
    ).drop("_alias", "_score")
    rows = rows.withColumn("manual_override", F.lit("N"))
    if rejects is not None:
        listed = rejects.select(
            "site_id", tx.normalize_name("cand_name").alias("_norm"), F.lit(True).alias("_reject")
        ).distinct()
        rows = rows.withColumn("_norm", tx.normalize_name("cand_name")).join(
            listed, ["site_id", "_norm"], "left"
        )
        rows = _cut(rows, F.col("_reject").isNotNull(), "manual_reject_excluded").drop("_norm", "_reject")
    if overrides is not None:
        fixed = overrides.select(
            "site_id",
            *[F.col(c).alias(f"_{c}") for c in ("cand_name", "cand_road", "cand_jibun")],
            F.lit(True).alias("_fixed"),
        )
        rows = rows.join(fixed, "site_id", "left")
        is_fixed = F.col("_fixed").isNotNull()
        rows = rows.withColumns(
            {
                **{c: F.when(is_fixed, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("cand_name", "cand_road", "cand_jibun")},
                "match_type": F.when(is_fixed, "manual_alias").otherwise(F.col("match_type")),
                "match_confidence": F.when(is_fixed, 1.0).otherwise(F.col("match_confidence")),
                "verified": F.when(is_fixed, "Y").otherwise(F.col("verified")),
                "manual_override": F.when(is_fixed, "Y").otherwise(F.col("manual_override")),
            }
        ).drop("_fixed", "_cand_name", "_cand_road", "_cand_jibun")
    rented = F.col("is_rental") & F.col("cand_name").isNotNull() & ~F.col("cand_name").contains("임대")
    return downgrade_risk(_cut(rows, rented, "rental_tenure_mismatch"))


def _cut(rows: DataFrame, test: Column, kind: str) -> DataFrame:
    test = F.coalesce(test, F.lit(False))
    return rows.withColumns(
        {
            "match_type": F.when(test, kind).otherwise(F.col("match_type")),
            "match_confidence": F.when(test, 0.0).otherwise(F.col("match_confidence")),
            "verified": F.when(test, "N").otherwise(F.col("verified")),
            "manual_override": F.when(test, "N").otherwise(F.col("manual_override")),
        }
    )


def risk_type() -> Column:
    """Risk of a verified row: only an equal road address with enough confidence is safe."""
    return (
        F.when(F.col("cand_name").isNull(), "VERIFIED_WITHOUT_CANDIDATE")
        .when(
            road_matches("cand_road") & (F.col("match_confidence") >= RISK_CEILING),
            "SAFE_ROAD_ADDRESS_EXACT_SCORE",
        )
        .when(road_matches("cand_road"), "MEDIUM_RISK_ROAD_ADDRESS_LOW_NAME_SCORE")
        .otherwise("MEDIUM_RISK_WITHOUT_ROAD_ADDRESS_EXACT")
    )


def downgrade_risk(rows: DataFrame) -> DataFrame:
    """Verified by machine without an equal road address: back to review, confidence at most 0.60."""
    risky = (
        (F.col("verified") == "Y") & (F.col("manual_override") != "Y") & risk_type().startswith("MEDIUM")
    )
    return rows.withColumns(
        {
            "match_type": F.when(risky, F.concat("match_type", F.lit("_risk_review"))).otherwise(F.col("match_type")),
            "match_confidence": F.when(risky, F.least("match_confidence", F.lit(RISK_CEILING))).otherwise(F.col("match_confidence")),
            "verified": F.when(risky, "N").otherwise(F.col("verified")),
        }
    )


def trusted() -> Column:
    """Usable for prices: fixed by hand, verified, or confidence of 0.9 and more."""
    return (F.col("manual_override") == "Y") | (F.col("verified") == "Y") | (F.col("match_confidence") >= 0.9)


def best_names(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """The most similar candidate name per site, among its lot if that has any, else its dong.

    Whatever its similarity; a name that shares no letter with any candidate has none. Pairs of
    distinct names are measured from the greatest upper bound down, each once. The best of every
    name so far is kept in a written table: pairs that can't reach it are left out, and a name
    ends as soon as no pair of a later round can.
    """
    lots = lot_blocks(sites, cands).select("site_id", "lot_count")
    lot, keys = F.col("lot_count").isNotNull(), ["gu", "dong_norm", "bonbun", "bubun"]
    # A dong is the block without lot number; of equal names in a block the one of most deals can be the best.
    no_lot = {"bonbun": F.lit(""), "bubun": F.lit("")}
    by_lot = cands.where("cand_bonbun <> ''").withColumns({"bonbun": F.col("cand_bonbun"), "bubun": F.col("cand_bubun")})
    names = by_lot.unionByName(cands.withColumns(no_lot)).groupBy(*keys, "cand_norm").agg(
        F.max_by(F.struct(*_CANDIDATE), F.struct("trade_count", "cand_name")).alias("_cand")
    )
    names = written(with_letters(names.where("cand_norm <> ''"), "cand_norm"))
    keyed = sites.join(lots, "site_id", "left").withColumns({c: F.when(lot, F.col(c)).otherwise(F.lit("")) for c in no_lot})
    keyed = written(keyed.select("site_id", *keys, "name_norm"))
    wanted = keyed.where("name_norm <> ''").select(*keys, "name_norm").distinct()
    # An equal name is the best at once, without measuring.
    equal = names.drop("cand_norm_letters").withColumnRenamed("cand_norm", "name_norm").withColumn("best_similarity", F.lit(1.0))
    state = with_letters(wanted, "name_norm").join(equal, [*keys, "name_norm"], "left").withColumnRenamed("_cand", "best")
    state = written(state.withColumn("best_similarity", F.coalesce("best_similarity", F.lit(0.0))))
    high = math.inf
    for low in NAME_BOUNDS:
        still = state.where(F.col("best_similarity") < min(high, 1.0))
        if still.isEmpty():
            break
        pairs = pairs_by_bound(still.drop("best"), names, "name_norm", "cand_norm", keys, low, high)
        measured = pairs.where("bound >= best_similarity").withColumn("_sim", similarity("name_norm", "cand_norm"))
        order = F.struct("_sim", "_cand.trade_count", "_cand.cand_name")
        found = measured.groupBy(*keys, "name_norm").agg(F.max_by("_cand", order).alias("_found"), F.max("_sim").alias("_sim"))
        ranked = lambda sim, c: F.struct(sim.alias("s"), F.coalesce(f"{c}.trade_count", F.lit(-1)).alias("n"), F.coalesce(f"{c}.cand_name", F.lit("")).alias("c"))
        better = F.col("_sim").isNotNull() & (ranked(F.col("_sim"), "_found") > ranked(F.col("best_similarity"), "best"))
        state = written(
            state.join(found, [*keys, "name_norm"], "left").select(
                *keys, "name_norm", "name_norm_letters", F.when(better, F.col("_found")).otherwise(F.col("best")).alias("best"),
                F.when(better, F.col("_sim")).otherwise(F.col("best_similarity")).alias("best_similarity"),
            )
        )
        high = low
    known = state.where("best_similarity > 0")
    return keyed.join(known, [*keys, "name_norm"]).select("site_id", "best", "best_similarity")


def audit(mapping: DataFrame, cands: DataFrame) -> DataFrame:
    """Status, address evidence and reason per row of a written mapping."""
    lots = lot_blocks(mapping, cands).select("site_id", "lot_count")
    dongs = cands.groupBy("gu", "dong_norm").agg(F.count("*").alias("dong_count"))
    names = best_names(mapping.select("site_id", "gu", "dong_norm", "bonbun", "bubun", "name_norm"), cands)
    rows = (
        mapping.join(lots, "site_id", "left")
        .join(dongs, ["gu", "dong_norm"], "left")
        .join(names, "site_id", "left")
        .fillna(0, ["lot_count", "dong_count"])
    )
    kind = F.col("match_type")
    status = (
        F.when(F.col("verified") == "Y", "verified").when(kind != "unmatched", "candidate").otherwise("unmatched")
    )
    scoped = F.when(F.col("lot_count") > 0, F.col("lot_count")).otherwise(F.col("dong_count"))
    related = F.coalesce(F.col("best_similarity") >= NAME_RELATED, F.lit(False))
    crowded = (
        kind.contains("ambiguous")
        | kind.contains("jibun_exact_candidate")
        | ((scoped > 1) & F.col("bonbun").isNotNull() & (kind != "same_dong_contains_candidate"))
    )
    reason = (
        F.when(status == "verified", "MATCHED")
        .when(crowded, "SAME_LOT_MULTIPLE_COMPLEX")
        .when(
            (status == "candidate") & kind.isin("gu_dong_name_exact_candidate", "same_dong_contains_candidate"),
            "LOW_CONFIDENCE",
        )
        .when((status == "candidate") & (kind.contains("contains") | related), "NAME_ALIAS")
        .when(status == "candidate", "LOW_CONFIDENCE")
        .when(F.col("dong_count") == 0, "NO_RECENT_TRANSACTION")
        .when(F.col("bonbun").isNull(), "MISSING_BONBUN_BUBUN")
        .when(related, "NAME_ALIAS")
        .when(scoped > 0, "POSSIBLE_MATCH_NEEDS_MANUAL_REVIEW")
        .otherwise("ADDRESS_MISMATCH")
    )
    evidence = (
        F.when(road_matches("cand_road"), "ROAD_ADDRESS_EXACT")
        .when(lot_matches("cand_bonbun", "cand_bubun"), "JIBUN_EXACT")
        .when(kind.contains("name"), "NAME_ONLY_REVIEW")
        .when(F.lower(kind).contains("alias"), "ALIAS_REVIEW")
        .otherwise("NO_ADDRESS_VALIDATION")
    )
    action = (
        F.when(status == "verified", "accept").when(status == "candidate", "review_candidate").otherwise("manual_mapping_needed")
    )
    return rows.withColumns(
        {
            "status": status,
            "reason": reason,
            "evidence": evidence,
            "recommended_action": action,
            "road_address_match": F.when(road_matches("cand_road"), "Y").otherwise("N"),
            "jibun_match": F.when(lot_matches("cand_bonbun", "cand_bubun"), "Y").otherwise("N"),
        }
    )


def reason_summary(audited: DataFrame) -> DataFrame:
    """Rows per reason, split by status; matched rows are left out."""
    return audited.where("reason <> 'MATCHED'").groupBy("reason").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("status") == "candidate").alias("candidate_count"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched_count"),
    )


def alias_report(audited: DataFrame) -> DataFrame:
    """Alias candidates with their review score (bonus for being the best name, and for the lot)."""
    bonus = F.when(F.col("lot_count") > 0, 0.07).otherwise(0.03)
    score = half_even(F.least(F.col("best_similarity") + bonus, F.lit(1.0)), 2)
    named = audited.where("reason = 'NAME_ALIAS' AND best IS NOT NULL")
    return named.select(
        "site_id", "name", "gu", "dong", F.col("best.cand_name").alias("candidate"),
        F.col("best.trade_count").alias("trade_count"), F.col("best.rent_count").alias("rent_count"),
        score.alias("score"),
        F.when(score >= APPROVE_REVIEW, "APPROVE_ALIAS_REVIEW").otherwise("MANUAL_REVIEW").alias("recommended_action"),
    )


def quick_review(audited: DataFrame) -> DataFrame:
    """Aliases just below automatic approval, with the ones that look wrong marked."""
    low, high = QUICK_REVIEW
    sim = F.col("best_similarity")
    wrong = (
        tx.number_conflict("name_norm", "best.cand_norm")
        | tx.number_asymmetry("name_norm", "best.cand_norm")
        | tx.only_generic("name_norm", "best.cand_norm")
    )
    near = audited.where((F.col("reason") == "NAME_ALIAS") & (F.col("lot_count") <= 1) & (sim >= low) & (sim < high))
    return near.select(
        "site_id", "name", F.col("best.cand_name").alias("candidate"), half_even(sim, 2).alias("score"),
        F.when(wrong, "REVIEW_REJECT").otherwise("REVIEW_APPROVE").alias("recommended_action"),
    )


def same_lot_review(audited: DataFrame, cands: DataFrame) -> DataFrame:
    """Sites whose lot holds several complexes, with all of them in one row, most similar first.

    Lots are grouped by distinct name, so the lists grow with the complexes on a lot, not with deals.
    """
    crowded = audited.where("reason = 'SAME_LOT_MULTIPLE_COMPLEX' AND lot_count > 0")
    by_lot = cands.withColumns({"bonbun": F.col("cand_bonbun"), "bubun": F.col("cand_bubun")})
    pairs = crowded.select("site_id", "name_norm", "gu", "dong_norm", "bonbun", "bubun").join(
        by_lot.select("gu", "dong_norm", "bonbun", "bubun", "cand_name", "cand_norm", "trade_count", "rent_count"),
        ["gu", "dong_norm", "bonbun", "bubun"],
    )
    scored = pairs.withColumn("_sim", similarity("name_norm", "cand_norm"))
    entry = F.struct(
        (-F.col("_sim")).alias("s"), (-(F.col("trade_count") + F.col("rent_count"))).alias("n"),
        "cand_name", "trade_count", "rent_count",
    )
    listed = scored.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    text = lambda field: F.array_join(F.transform("_l", lambda x: x[field].cast("string")), "|")
    return listed.select(
        "site_id", text("cand_name").alias("candidate_names"), F.size("_l").cast("long").alias("candidate_count"),
        text("trade_count").alias("trade_counts"), text("rent_count").alias("rent_counts"),
    )


def missing_lot_report(audited: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites without a usable lot number, and why."""
    raw = sites.select("site_id", F.col("jibun").alias("detail"))
    reason = F.when(tx.clean("detail").isNull(), "DETAIL_ADDRESS_EMPTY").otherwise("KAPT_ADDRESS_UNPARSEABLE")
    return (
        audited.where("reason = 'MISSING_BONBUN_BUBUN'")
        .join(raw, "site_id")
        .select("site_id", "name", "gu", "dong", "detail", reason.alias("missing_reason"))
    )


def verified_audit(mapping: DataFrame) -> DataFrame:
    """Risk and advice for every row that is, or was, verified."""
    was = F.col("match_type").contains("risk_review")
    risk = risk_type()
    action = (
        F.when(was, "DOWNGRADED_FROM_VERIFIED")
        .when(risk.startswith("SAFE"), "KEEP")
        .when(risk.startswith("VERIFIED"), "REVIEW")
        .otherwise("DOWNGRADE_OR_REVIEW")
    )
    rows = mapping.where((F.col("verified") == "Y") | was)
    return rows.select(
        "site_id", "cand_name", "match_type", "match_confidence", "verified",
        risk.alias("risk_type"), action.alias("recommended_action"),
    )


def risk_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("risk_type").agg(F.count("*").alias("count"))


def reverse_audit(audited: DataFrame, sites: DataFrame, cands: DataFrame) -> DataFrame:
    """Is the candidate's name itself another site's name?

    The master names are rolled up per normalised name (count, first, second by id), so that a
    common name costs one row, not all its pairs.
    """
    masters = sites.where("name_norm <> ''").groupBy(F.col("name_norm").alias("cand_norm")).agg(
        F.count("*").alias("masters"), F.min(F.struct("site_id", "name")).alias("first")
    )
    raw_names = cands.groupBy("gu", "dong_norm", "cand_norm").agg(F.count("*").alias("raw_count"))
    open_rows = audited.where("status <> 'verified'")
    best = F.coalesce("cand_norm", "best.cand_norm")
    rows = (
        open_rows.withColumn("_shown", F.coalesce("cand_name", "best.cand_name"))
        .withColumn("cand_norm", best)
        .join(masters, "cand_norm", "left")
        .join(raw_names, ["gu", "dong_norm", "cand_norm"], "left")
        .withColumn("_sim", similarity("name_norm", "cand_norm"))
    )
    same_name = F.col("name_norm") == F.col("cand_norm")
    others = F.when(same_name, F.lit(0)).otherwise(F.coalesce("masters", F.lit(0)))
    validated = address_validated("cand_road", "cand_bonbun", "cand_bubun")
    core = tx.strip_dong(F.col("name_norm"), tx.normalize_name("dong"))
    lineage = (
        (F.col("_sim") >= LINEAGE_SIMILARITY)
        & ~tx.number_conflict("name_norm", "cand_norm")
        & ~tx.only_generic("name_norm", "cand_norm")
    )
    kind = (
        F.when(F.col("_shown").isNull(), "NO_MASTER_MATCH")
        .when((others == 1) & validated, "REBUILD_RENAME_CANDIDATE")
        .when(others == 1, "CANDIDATE_EXISTS_IN_MASTER")
        .when(others > 1, "AMBIGUOUS_MASTER_MATCH")
        .when((core != "") & (core == F.col("cand_norm")) & ~same_name, "DONG_PREFIX_ALIAS")
        .when(F.coalesce("raw_count", F.lit(0)) > 1, "AMBIGUOUS_MASTER_MATCH")
        .when(lineage, "GENERIC_ALIAS")
        .when(F.coalesce("masters", F.lit(0)) > 0, "AMBIGUOUS_MASTER_MATCH")
        .otherwise("NO_MASTER_MATCH")
    )
    action = (
        F.when(kind == "REBUILD_RENAME_CANDIDATE", "MANUAL_REVIEW_REBUILD_RENAME")
        .when(kind == "CANDIDATE_EXISTS_IN_MASTER", "REJECT_FOR_CURRENT_AND_ASSIGN_TO_EXISTING_MASTER")
        .when((kind == "DONG_PREFIX_ALIAS") & (F.col("lot_count") == 1) & lot_matches("cand_bonbun", "cand_bubun"), "REVIEW_ADDRESS_VALIDATED_ALIAS")
        .when(kind == "DONG_PREFIX_ALIAS", "ADDRESS_VALIDATION_REQUIRED")
        .when(kind == "GENERIC_ALIAS", "REVIEW_APPROVE_IF_ADDRESS_OK")
        .when(F.col("_shown").isNull(), "NO_CANDIDATE")
        .otherwise("MANUAL_REVIEW")
    )
    return rows.select(
        "site_id", "name", "gu", "dong", F.col("_shown").alias("candidate"), "match_confidence",
        (F.col("trade_count") + F.col("rent_count")).alias("deals"),
        kind.alias("reverse_type"), action.alias("recommended_action"),
        F.when(others >= 1, F.col("first.name")).alias("matched_master"),
    )


def review_batch(reverse: DataFrame) -> DataFrame:
    """The rows a person should look at, in order."""
    order = {"REBUILD_RENAME_CANDIDATE": 0, "CANDIDATE_EXISTS_IN_MASTER": 1, "DONG_PREFIX_ALIAS": 2}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("reverse_type"))
    return (
        reverse.where(F.col("reverse_type").isin(list(order)))
        .withColumn("place", place)
        .orderBy("place", F.desc("match_confidence"), F.desc(F.coalesce("deals", F.lit(0))), "gu", "dong", "name")
    )


def attach_deals(mapping: DataFrame, deals: DataFrame) -> DataFrame:
    """Deals of every trusted site: full key, else (gu, dong, name), else the same name in one dong.

    ``mapping``: ``site_id, gu, dong, cand_name, cand_road`` and trust columns; ``deals``:
    ``gu, dong, apartment_name, road_address`` and the rest. Which of the three holds is decided
    on distinct spellings; the deals are then joined once, on their own text.
    """
    wanted = mapping.where(trusted()).select(
        "site_id", "gu", tx.normalize_dong("dong").alias("dong_norm"),
        tx.normalize_name("cand_name").alias("_name"), tx.normalize_address("cand_road").alias("_road"),
    ).where("_name <> ''")
    raw = ["gu", "dong", "apartment_name", "road_address"]
    spelled = deals.select(*raw).distinct().withColumns(
        {
            "dong_norm": tx.normalize_dong("dong"),
            "_name": tx.normalize_name("apartment_name"),
            "_road": tx.normalize_address("road_address"),
        }
    )
    keys = spelled.select("gu", "dong_norm", "_name", "_road").distinct()
    full = wanted.join(keys, ["gu", "dong_norm", "_name", "_road"], "left_semi").withColumn("how", F.lit("full_key"))
    left = wanted.join(full.select("site_id"), "site_id", "left_anti")
    same_dong = left.drop("_road").join(keys, ["gu", "dong_norm", "_name"]).withColumn("how", F.lit("same_dong"))
    left = left.join(same_dong.select("site_id"), "site_id", "left_anti")
    only = keys.groupBy("gu", "_name").agg(
        F.count_distinct("dong_norm").alias("_dongs"), F.min("dong_norm").alias("dong_norm")
    ).where("_dongs = 1").drop("_dongs")
    rescued = (
        left.drop("dong_norm", "_road").join(only, ["gu", "_name"])
        .join(keys, ["gu", "dong_norm", "_name"])
        .withColumn("how", F.lit("single_dong"))
    )
    cols = ["site_id", "gu", "dong_norm", "_name", "_road", "how"]
    chosen = full.select(cols).unionByName(same_dong.select(cols)).unionByName(rescued.select(cols))
    texts = chosen.join(spelled, ["gu", "dong_norm", "_name", "_road"]).select("site_id", "how", *raw)
    same = F.lit(True)
    for c in raw:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}"))
    joined = deals.alias("d").join(texts.alias("t"), same)
    return joined.select("t.site_id", "t.how", "d.*")


def dong_mismatch(mapping: DataFrame, deals: DataFrame) -> DataFrame:
    """Trusted sites whose deals carry another dong: rescued (one dong) or held (several)."""
    wanted = mapping.where(trusted()).select(
        "site_id", "name", "gu", F.col("dong").alias("master_dong"), tx.normalize_dong("dong").alias("dong_norm"),
        tx.normalize_name("cand_name").alias("_name"),
    ).where("_name <> ''")
    counts = (
        deals.select("gu", tx.normalize_dong("dong").alias("dong_norm"), tx.normalize_name("apartment_name").alias("_name"))
        .groupBy("gu", "_name", "dong_norm")
        .agg(F.count("*").alias("n"))
    )
    strays = wanted.join(counts, ["gu", "_name", "dong_norm"], "left_anti")
    names = counts.groupBy("gu", "_name").agg(
        F.array_join(F.array_sort(F.collect_set("dong_norm")), "|").alias("deal_dongs"),
        F.count("*").alias("_dongs"), F.sum("n").alias("row_count"),
    )
    status = F.when(F.col("_dongs") == 1, "rescued").otherwise("held")
    return strays.join(names, ["gu", "_name"]).select(
        "site_id", "name", "gu", "master_dong", "deal_dongs", "row_count", status.alias("status")
    )


def live_name_match(sites: DataFrame, deals: DataFrame) -> DataFrame:
    """Looser match at read time: equal names, or contained (four letters) in the same dong."""
    own = sites.select("site_id", tx.normalize_name("name").alias("name_norm"), tx.normalize_dong("dong").alias("dong_norm"))
    names = deals.select(
        tx.normalize_name("apartment_name").alias("deal_norm"), tx.normalize_dong("dong").alias("dong_norm")
    ).distinct()
    equal = (
        own.withColumnRenamed("dong_norm", "_own")
        .join(names.withColumn("name_norm", F.col("deal_norm")), "name_norm")
        .select("site_id", "deal_norm", "dong_norm")
    )
    held = containment_join(own, names, "name_norm", "deal_norm", ("dong_norm",), shortest=4)
    return equal.unionByName(held.select("site_id", "deal_norm", "dong_norm")).where("deal_norm <> ''").distinct()
