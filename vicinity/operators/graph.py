"""Connected cells and distance to the border on the grid."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TILE = 256
_J_OFFSET = 1 << 30


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels the cells of one tile by their component's smallest cell inside the tile."""
    left = set(zip(pdf["i"].tolist(), pdf["j"].tolist()))
    i_out, j_out, labels = [], [], []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        label = (start[0] << 31) + start[1] + _J_OFFSET
        queue = deque([start])
        while queue:
            i, j = queue.popleft()
            i_out.append(i)
            j_out.append(j)
            labels.append(label)
            for near in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if near in left:
                    left.discard(near)
                    queue.append(near)
    return pd.DataFrame({"i": i_out, "j": j_out, "label": labels})


def components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``(i, j, cid)``: 4-neighbour components, named by their smallest cell.

    Every tile of the grid is labelled on its own (a tile has at most ``tile * tile`` cells,
    however the data are spread). Only tile labels that touch across a seam remain to be merged,
    a far smaller graph, solved by alternating large-star and small-star rounds.
    """
    tiled = cells.select("i", "j").distinct().withColumns(
        {"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)}
    )
    labelled = cut(
        tiled.groupBy("ti", "tj").applyInPandas(
            lambda pdf: _label_tile(pdf), "i int, j int, label long"
        )
    )
    below = labelled.where(f"pmod(i, {tile}) = {tile - 1}").select((F.col("i") + 1).alias("i"), "j", F.col("label").alias("u"))
    right = labelled.where(f"pmod(j, {tile}) = {tile - 1}").select("i", (F.col("j") + 1).alias("j"), F.col("label").alias("u"))
    first = labelled.where(f"pmod(i, {tile}) = 0 OR pmod(j, {tile}) = 0")
    seams = (
        below.unionByName(right).join(first.withColumnRenamed("label", "v"), ["i", "j"]).select("u", "v").distinct()
    )
    roots = merge_labels(seams)
    return labelled.join(roots, labelled["label"] == roots["node"], "left").select(
        "i", "j", F.coalesce("root", "label").alias("cid")
    )


def merge_labels(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list ``(u, v)``; the root is the minimum.

    Large-star links the larger neighbours of a node to the smallest one, small-star the smaller
    ones; the rounds are logarithmic in the length of the longest chain. Minima are folded map-side
    before the shuffle, so a node with very many edges is no hot spot. Each round is written out.
    """
    edges = cut(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).selectExpr("u", "least(u, _m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        edges = cut(star.unionByName(small.selectExpr("u", "m AS v")).distinct())
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == mark:
            return edges.selectExpr("u AS node", "v AS root")
        mark = tuple(total)


def border_distance(inside: DataFrame, box: tuple[int, int, int, int], cell_m: int = 100) -> DataFrame:
    """Metres from every cell of the box to the nearest cell that is not ``inside``, in grid steps.

    Spreading outward through inside cells from all outside cells gives the plain grid-step (L1)
    distance to the nearest outside cell: a shortest path cannot meet an outside cell earlier.
    That distance separates into a pass along rows and a pass along columns, so two windows over
    one row and one column of the box replace the search; no iteration.
    """
    i0, i1, j0, j1 = box
    spark = inside.sparkSession
    box_cells = spark.range(i0, i1 + 1).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(j0), F.lit(j1))).alias("j")
    )
    known = box_cells.join(inside.select("i", "j", F.lit(True).alias("_in")).distinct(), ["i", "j"], "left")
    so_far = lambda key, order: (
        Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = F.when(F.col("_in").isNull(), F.col("j"))
    before = F.last(out, ignorenulls=True).over(so_far("i", F.asc("j")))
    after = F.last(out, ignorenulls=True).over(so_far("i", F.desc("j")))
    rows = known.select("i", "j", F.least(F.col("j") - before, after - F.col("j")).alias("g"))
    above = F.min(F.col("g") - F.col("i")).over(so_far("j", F.asc("i"))) + F.col("i")
    beneath = F.min(F.col("g") + F.col("i")).over(so_far("j", F.desc("i"))) - F.col("i")
    steps = F.coalesce(F.least(above, beneath), F.lit(0))
    return rows.select("i", "j", (steps * cell_m).cast("int").alias("border_m"))
