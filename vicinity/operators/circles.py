"""Counts and nearest places inside circles, without making the pairs.

Sites and places are dealt to tiles at least as wide as the radius, places also to the tiles their circle reaches. A tile is
worked off in numpy. For counts its places lie in thin bands of latitude, sorted by longitude: in each band a circle holds
an interval for sure (a difference of running sums) and may hold a little more on both sides, which is measured. The
nearest places are looked for in squares of cells that double until nothing outside can be nearer. The work of a site
grows with the rim of its circle, not with its area. Crowded tiles are split on both sides, and their parts summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.geo import EARTH_RADIUS_M, METRES_PER_DEG

#: Least side of a tile in metres; sites and places (with those around the tile) that one task holds at once.
TILE_M, SITES_AT_ONCE, PLACES_AT_ONCE = 1000, 30_000, 300_000
#: Sites worked off together, pairs measured together, kinds counted together.
_BLOCK, _PAIRS, _KINDS = 4096, 2_000_000, 32
#: Pairs this near a limit (in metres) are measured like the operators on pairs do; slack of an angle.
_NEAR_LIMIT, _SLACK = 1e-6, 1e-9
_WORST_LAT = 89.0


def _tiled(sites: DataFrame, places: DataFrame, radius_m: float, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_band, _cell, _s, _p``: the tile, and the part of its sites and places (``whole``: all places)."""
    side, reach = (max(radius_m, TILE_M) + 1) / METRES_PER_DEG, (radius_m + 1) / METRES_PER_DEG
    farthest = f"(greatest(abs(_band), abs(_band + 1)) * {side!r}D + {side!r}D)"
    width = f"({side!r}D / cos(radians(least({farthest}, {_WORST_LAT}D))))"
    span = f"({reach!r}D / cos(radians(least(abs(lat) + {reach!r}D, {_WORST_LAT}D))))"
    usable = "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)"
    sites = sites.where(usable).selectExpr("*", f"floor(lat / {side!r}D) AS _band").selectExpr("*", f"floor(lng / {width}) AS _cell")
    places = places.where(usable).selectExpr(
        "*", f"explode(sequence(floor((lat - {reach!r}D) / {side!r}D), floor((lat + {reach!r}D) / {side!r}D))) AS _band"
    ).selectExpr("*", f"explode(sequence(floor((lng - {span}) / {width}), floor((lng + {span}) / {width}))) AS _cell")
    tile = ["_band", "_cell"]
    parts = lambda df, most, name: df.groupBy(*tile).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # Only crowded tiles are listed, one for so many rows at most, so that this list may go through the driver.
    counted = parts(sites, SITES_AT_ONCE, "_ns").join(parts(places, PLACES_AT_ONCE, "_np"), tile, "full")
    counted = counted.withColumn("_np", F.lit(1)) if whole else counted
    split = F.broadcast(counted.where("_ns > 1 OR _np > 1"))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = lambda df: df.join(split, tile, "left").fillna(1, ["_ns", "_np"])
    sites = known(sites).withColumn("_s", own(sites, "_ns")).withColumn("_p", every("_np"))
    places = known(places).withColumn("_p", own(places, "_np")).withColumn("_s", every("_ns"))
    return sites.drop("_ns", "_np"), places.drop("_ns", "_np")


def _worked_off(
    sites: DataFrame, places: DataFrame, radius_m: float, schema: str | StructType, work: Callable[[pa.Table, pa.Table], pa.Table], whole: bool = False
) -> DataFrame:
    keys = ["_band", "_cell", "_s", "_p"]
    a, b = _tiled(sites, places, radius_m, whole)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(work, schema)


def _half_chords(limit_m: float) -> tuple[float, float]:
    """Squared half chords that are surely within and surely beyond the limit."""
    at = lambda m: math.sin(min(max(m, 0.0) / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2
    return at(limit_m - _NEAR_LIMIT), at(limit_m + _NEAR_LIMIT)


def _metres(chord: np.ndarray) -> np.ndarray:
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(chord), np.sqrt(1 - chord))


def _within(chord: np.ndarray, radius_m: float, rounding: str) -> np.ndarray:
    sure, beyond = _half_chords(radius_m + 0.5 if rounding == "before" else radius_m)
    inside = chord <= sure
    close = np.flatnonzero((chord > sure) & (chord <= beyond))
    if len(close):
        metres = _metres(chord[close])
        inside[close] = (np.rint(metres) if rounding == "before" else metres) <= radius_m
    return inside


class _Points:
    """Coordinates in radians, as arrays."""

    def __init__(self, table: pa.Table):
        read = lambda c: np.radians(table.column(c).to_numpy())
        self.lat, self.lng = read("lat"), read("lng")
        self.cos = np.cos(self.lat)

    def some(self, which: np.ndarray) -> _Points:
        out = object.__new__(_Points)
        out.lat, out.lng, out.cos = self.lat[which], self.lng[which], self.cos[which]
        return out

    def chord(self, k: np.ndarray, other: _Points, j: np.ndarray) -> np.ndarray:
        """Squared half chords of pairs."""
        a, b = np.sin((other.lat[j] - self.lat[k]) / 2), np.sin((other.lng[j] - self.lng[k]) / 2)
        return a * a + self.cos[k] * other.cos[j] * b * b


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: of which range each number is, and the numbers."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) + np.repeat(low - (np.cumsum(size) - size), size)


def _counted(sites: _Points, places: _Points, kind: np.ndarray, n: np.ndarray, kinds: int, radius_m: float, rounding: str) -> np.ndarray:
    """Places (``n`` each) by kind inside the circle of every site."""
    sure, beyond = _half_chords(radius_m + 0.5 if rounding == "before" else radius_m)
    angle = 2 * math.asin(math.sqrt(beyond))
    area = max(np.ptp(places.lat) * np.ptp(places.lng) * places.cos.mean(), 1e-18) * EARTH_RADIUS_M**2
    height = min(max(math.sqrt(5 * area / len(n)), radius_m / 200), max(radius_m, 1.0)) / EARTH_RADIUS_M
    base, west = math.floor(places.lat.min() / height), places.lng.min()
    band = (np.floor(places.lat / height) - base).astype(np.int64)
    bands = int(band.max()) + 1
    wide = 2 * (np.ptp(places.lng) + 1e-6)
    order = np.lexsort((places.lng, band))
    key = band[order] * wide + (places.lng[order] - west)
    sums = np.zeros((len(n) + 1, kinds), np.int64)
    sums[np.arange(1, len(n) + 1), kind[order]] = n[order]
    np.cumsum(sums, axis=0, out=sums)
    # Cosines of the two edges of a band; the circle is widest where the cosine is least.
    edges = np.cos((base + np.arange(bands + 1)) * height)
    least, most = np.minimum(edges[:-1], edges[1:]), np.maximum(edges[:-1], edges[1:])
    crosses = ((base + np.arange(bands)) * height < 0) & ((base + np.arange(bands) + 1) * height > 0)
    most = np.where(crosses, 1.0, most)
    out = np.zeros((len(sites.lat), kinds), np.int64)
    for start in range(0, len(sites.lat), _BLOCK):
        block = np.arange(start, min(start + _BLOCK, len(sites.lat)))
        first = np.floor((sites.lat[block] - angle - _SLACK) / height).astype(np.int64) - base
        last = np.floor((sites.lat[block] + angle + _SLACK) / height).astype(np.int64) - base
        open_k, open_j, size = [], [], 0

        def measured() -> None:
            k, j = np.concatenate(open_k), np.concatenate(open_j)
            hit = np.flatnonzero(_within(sites.chord(block[k], places, j), radius_m, rounding))
            add = np.bincount(k[hit] * kinds + kind[j[hit]], n[j[hit]], len(block) * kinds)  # noqa: B023 - used at once
            out[block] += np.rint(add).astype(np.int64).reshape(len(block), kinds)  # noqa: B023

        for step in range(int((last - first).max()) + 1):
            at = first + step
            use = np.flatnonzero((at >= 0) & (at < bands) & (at <= last))
            if not len(use):
                continue
            at, k = at[use], block[use]
            south, north = (base + at) * height - sites.lat[k], (base + at + 1) * height - sites.lat[k]
            near = np.where((south < 0) & (north > 0), 0.0, np.minimum(np.abs(south), np.abs(north)))
            far = np.maximum(np.abs(south), np.abs(north)) + _SLACK
            half = lambda chord, d, cos: 2 * np.arcsin(np.sqrt(np.clip((chord - np.sin(d / 2) ** 2) / np.maximum(sites.cos[k] * cos, 1e-12), 0, 1)))  # noqa: B023, E731
            outer = half(beyond, np.maximum(near - _SLACK, 0), least[at]) + _SLACK
            inner = half(sure, far, most[at]) - _SLACK
            x = sites.lng[k] - west
            span = lambda w, side: np.searchsorted(key, at * wide + np.clip(x + w, -wide / 4, 3 * wide / 4), side)  # noqa: B023, E731
            a, d = span(-outer, "left"), span(outer, "right")
            b, c = span(-inner, "left"), span(inner, "right")
            none = inner <= 0
            b, c = np.where(none, a, b), np.where(none, a, c)
            out[k] += sums[c] - sums[b]
            for low, high in ((a, b), (c, d)):
                of, j = _ranges(low, high)
                if len(of):
                    open_k.append(use[of])
                    open_j.append(order[j])
                    size += len(of)
            if size > _PAIRS:
                measured()
                open_k, open_j, size = [], [], 0
        if size:
            measured()
    return out


def _searched(sites: _Points, places: _Points, wanted: int, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``(site, place, squared half chord)`` that hold the ``wanted`` nearest places of every site within the radius
    (and all that are as near in whole metres); the pairs of a site come in one piece."""
    reach = 2 * math.asin(math.sqrt(_half_chords(radius_m + 0.5)[1]))
    scale = max(min(sites.cos.min(), places.cos.min()), 1e-6)
    extent = max(np.ptp(places.lat), np.ptp(places.lng) * scale, 1e-9)
    apart = lambda a, b: max(a.max(), b.max()) - min(a.min(), b.min())
    every = max(apart(sites.lat, places.lat), apart(sites.lng, places.lng) * scale, 1e-8)
    # Cells that hold a circle; where longitudes are too narrow for that, or few cells are needed, all there is.
    widest = min(max(reach * 1.01, 1e-8), every) if reach / scale < 0.2 else every
    cell = min(max(extent * math.sqrt((wanted + 1) / len(places.lat)), 1e-8), widest)
    south, west = places.lat.min(), places.lng.min()
    open_sites = np.arange(len(sites.lat))
    slack = 1.5 / EARTH_RADIUS_M
    while len(open_sites):
        last = cell >= widest
        row, col = np.floor((places.lat - south) / cell).astype(np.int64), np.floor((places.lng - west) * scale / cell).astype(np.int64)
        wide = int(col.max()) + 5
        key = row * wide + col + 2
        order = np.argsort(key, kind="stable")
        key = key[order]
        left = []
        at = 0
        size = _BLOCK
        while at < len(open_sites):
            k = open_sites[at : at + size]
            r = np.floor((sites.lat[k] - south) / cell).astype(np.int64)
            c = np.floor((sites.lng[k] - west) * scale / cell).astype(np.int64)
            bounds = []
            for step in (-1, 0, 1):
                lo, hi = np.clip(c - 1, -2, wide - 3), np.clip(c + 1, -2, wide - 3)
                base = (r + step) * wide + 2
                bounds.append((np.searchsorted(key, base + lo, "left"), np.searchsorted(key, base + hi, "right")))
            low, high = (np.stack([x[y] for x in bounds], axis=1).ravel() for y in (0, 1))
            if np.maximum(high - low, 0).sum() > _PAIRS and size > 1:
                size = max(size // 4, 1)
                continue
            of, j = _ranges(low, high)
            of, j = of // 3, order[j]
            chord = sites.chord(k[of], places, j)
            # Nothing outside the square is nearer than its nearest side.
            to_lat = 1.5 * cell - np.abs((sites.lat[k] - south) - (r + 0.5) * cell)
            to_lng = np.minimum((1.5 * cell - np.abs((sites.lng[k] - west) * scale - (c + 0.5) * cell)) / scale, math.pi)
            edge = 2 * np.arcsin(np.clip(np.minimum(np.sin(np.clip(to_lat, 0, math.pi) / 2), scale * np.sin(to_lng / 2)), 0, 1))
            sure = np.sin(np.maximum(edge - _SLACK - slack, 0) / 2) ** 2
            inside = np.bincount(of[chord < sure[of]], minlength=len(k))
            done = np.full(len(k), True) if last else inside >= wanted
            kept = done[of] & (chord <= (np.sin(reach / 2) ** 2 if last else math.inf))
            yield k[of[kept]], j[kept], chord[kept]
            left.append(k[~done])
            at += size
        open_sites = np.concatenate(left)
        cell = min(cell * 2, widest)


def counts(
    sites: DataFrame, places: DataFrame, radii: Sequence[float], *, kinds: Sequence[str] | None = None, rounding: str = "before", nearest: bool = True
) -> DataFrame:
    """Places around each point, by radius or by kind: ``lat, lng, count_0.., nearest_0..``.

    ``sites``: distinct ``lat, lng``; ``places``: ``lat, lng, n`` (so many at that place) and, with ``kinds`` (for one
    radius), ``kind``. Without kinds there is a count for each radius and one nearest distance, else a count and a nearest
    distance for each kind and, last, those of all other kinds. Points without places may be missing.
    """
    names = list(kinds) if kinds is not None else []
    groups = len(names) + 1 if kinds is not None else 1
    code = F.lit(0)
    if kinds is not None:
        code = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("kind")).cast("int"), F.lit(0))
        code = F.when(code == 0, F.lit(len(names))).otherwise(code - 1)
    places = places.select("lat", "lng", F.col("n").cast("long").alias("n"), code.cast("int").alias("kind"))
    columns = groups if kinds is not None else len(radii)
    farthest = max(radii)
    fields = [f"count_{k} long" for k in range(columns)] + [f"nearest_{k} int" for k in range(groups if nearest else 0)]
    schema = "lat double, lng double, " + ", ".join(fields)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        want = pa.schema([("lat", pa.float64()), ("lng", pa.float64())] + [(f.split()[0], pa.int64() if f.endswith("long") else pa.int32()) for f in fields])
        if not (a.num_rows and b.num_rows):
            return want.empty_table()
        s, p = _Points(a), _Points(b)
        kind, n = b.column("kind").to_numpy(), b.column("n").to_numpy()
        if kinds is not None:
            found = _counted(s, p, kind, n, groups, farthest, rounding)
        else:
            found = np.concatenate([_counted(s, p, kind, n, 1, r, rounding) for r in radii], axis=1)
        out = [a.column("lat").combine_chunks(), a.column("lng").combine_chunks(), *(pa.array(found[:, k]) for k in range(columns))]
        for g in range(groups if nearest else 0):
            out.append(_nearest_metres(s, p, np.flatnonzero(kind == g), farthest, rounding))
        return pa.Table.from_arrays(out, schema=want)

    parts = _worked_off(sites.select("lat", "lng"), places, farthest, schema, work)
    total = [F.sum(f"count_{k}").alias(f"count_{k}") for k in range(columns)]
    return parts.groupBy("lat", "lng").agg(*total, *[F.min(f"nearest_{k}").alias(f"nearest_{k}") for k in range(groups if nearest else 0)])


def counts_by(sites: DataFrame, places: DataFrame, radius_m: float, by: str, *, rounding: str = "before") -> DataFrame:
    """Places and the nearest of them around each point for every value of ``by`` that occurs there: ``lat, lng, <by>,
    count, nearest``. ``sites``: distinct ``lat, lng``; ``places``: ``lat, lng, n, <by>``."""
    places = places.select("lat", "lng", F.col("n").cast("long").alias("n"), by)
    schema = f"lat double, lng double, `{by}` {dict(places.dtypes)[by]}, count long, nearest int"

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        fields = [pa.field("lat", pa.float64()), pa.field("lng", pa.float64()), b.schema.field(by), pa.field("count", pa.int64()), pa.field("nearest", pa.int32())]
        parts = [pa.schema(fields).empty_table()]
        if a.num_rows and b.num_rows:
            s, p, n = _Points(a), _Points(b), b.column("n").to_numpy()
            coded = pa.array(b.column(by).combine_chunks()).dictionary_encode(null_encoding="encode")
            kind = coded.indices.to_numpy()
            for low in range(0, len(coded.dictionary), _KINDS):
                some = np.flatnonzero((kind >= low) & (kind < low + _KINDS))
                found = _counted(s, p.some(some), kind[some] - low, n[some], _KINDS, radius_m, rounding)
                for g in np.flatnonzero(found.any(axis=0)):
                    which = np.flatnonzero(kind == low + g)
                    rows, name = pa.array(np.flatnonzero(found[:, g])), pa.array(np.full(int((found[:, g] > 0).sum()), which[0]))
                    near = _nearest_metres(s, p, which, radius_m, rounding).take(rows)
                    at, value = a.select(["lat", "lng"]).take(rows), b.select([by]).take(name)
                    own = [at.column(0), at.column(1), value.column(0), pa.array(found[:, g]).take(rows), near]
                    parts.append(pa.Table.from_arrays(own, schema=pa.schema(fields)))
        return pa.concat_tables(parts)

    parts = _worked_off(sites.select("lat", "lng"), places, radius_m, schema, work)
    return parts.groupBy("lat", "lng", by).agg(F.sum("count").alias("count"), F.min("nearest").alias("nearest"))


def _nearest_metres(sites: _Points, places: _Points, some: np.ndarray, radius_m: float, rounding: str) -> pa.Array:
    """Whole metres to the nearest of some places within the radius."""
    best = np.full(len(sites.lat), math.inf)
    if len(some):
        for k, _, chord in _searched(sites, places.some(some), 1, radius_m):
            if len(k):
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                best[k[starts]] = np.minimum.reduceat(chord, starts)
    known = np.isfinite(best)
    known[known] = _within(best[known], radius_m, rounding)
    metres = np.zeros(len(best), np.int32)
    metres[known] = np.rint(_metres(best[known])).astype(np.int32)
    return pa.array(metres, mask=~known)


def nearest(
    sites: DataFrame, places: DataFrame, radius_m: float, wanted: int, *, by: Sequence[str] = (), keep: Sequence[str] = (), id_col: str = "poi_id",
    rounding: str = "before",
) -> DataFrame:
    """The ``wanted`` nearest places of each point within the radius, for each value of ``by``: ``lat, lng, <by>, <id>,
    <keep>, distance_m, rank`` (ties: smallest id)."""
    kept = list(dict.fromkeys([*by, id_col, *keep]))
    # Of the places at one spot no more than that can be wanted.
    spot = Window.partitionBy("lat", "lng", *by).orderBy(id_col)
    places = places.select("lat", "lng", *kept).withColumn("_rank", F.row_number().over(spot)).where(F.col("_rank") <= wanted).drop("_rank")
    # Lists keep what Spark knows of their elements, which a type as text would lose.
    schema = StructType([*StructType.fromDDL("lat double, lng double, distance_m int"), *(StructField(c, places.schema[c].dataType) for c in kept)])

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        want = [pa.field("lat", pa.float64()), pa.field("lng", pa.float64()), pa.field("distance_m", pa.int32()), *(b.schema.field(c) for c in kept)]
        if not (a.num_rows and b.num_rows):
            return pa.schema(want).empty_table()
        s, p, group = _Points(a), _Points(b), np.zeros(b.num_rows, np.int64)
        for c in by:
            coded = pa.array(b.column(c).combine_chunks()).dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
        ids = np.unique(b.column(id_col).to_numpy(), return_inverse=True)[1]
        rows_k, rows_j, rows_m = [], [], []
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            for k, j, chord in _searched(s, p.some(some), wanted, radius_m):
                hit = np.flatnonzero(_within(chord, radius_m, rounding))
                k, j, metres = k[hit], some[j[hit]], np.rint(_metres(chord[hit])).astype(np.int32)
                order = np.lexsort((ids[j], metres, k))
                k, j, metres = k[order], j[order], metres[order]
                begun = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
                place = np.arange(len(k)) - np.maximum.accumulate(np.where(begun, np.arange(len(k)), 0))
                top = place < wanted
                rows_k.append(k[top])
                rows_j.append(j[top])
                rows_m.append(metres[top])
        k, j, metres = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows_k, rows_j, rows_m))
        took, met = a.select(["lat", "lng"]).take(pa.array(k)), b.select(kept).take(pa.array(j))
        return pa.Table.from_arrays([took.column(0), took.column(1), pa.array(metres.astype(np.int32)), *met.columns], schema=pa.schema(want))

    parts = _worked_off(sites.select("lat", "lng"), places, radius_m, schema, work)
    order = Window.partitionBy("lat", "lng", *by).orderBy("distance_m", id_col)
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select("lat", "lng", *kept, "distance_m", "rank")


def members(sites: DataFrame, places: DataFrame, radius_m: float, kinds: int, first: int, *, rounding: str = "before") -> DataFrame:
    """Distinct members of all places in the circle of each point: ``lat, lng, count, kind_0.., firsts``.

    ``places``: ``lat, lng, members``, an array of numbers; the remainder of a number by ``kinds`` is its kind. ``firsts`` are
    the ``first`` smallest numbers. A place's members are bits, a circle's those that any of its places has; the places of
    a tile (not its sites) are in one task, as their members cannot be summed.
    """
    schema = "lat double, lng double, count long, " + ", ".join(f"kind_{k} long" for k in range(kinds)) + ", firsts array<long>"

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        fields = pa.schema(
            [("lat", pa.float64()), ("lng", pa.float64()), ("count", pa.int64()), *((f"kind_{k}", pa.int64()) for k in range(kinds)), ("firsts", pa.list_(pa.int64()))]
        )
        parts = [fields.empty_table()]
        listed = b.column("members").combine_chunks() if b.num_rows else None
        if a.num_rows and listed is not None and len(listed.flatten()):
            s, p = _Points(a), _Points(b)
            size = np.diff(listed.offsets.to_numpy())
            numbers, at = np.unique(listed.flatten().to_numpy(), return_inverse=True)
            bits = np.zeros((-(-len(numbers) // 64), len(size)), np.uint64)
            np.bitwise_or.at(bits, (at // 64, np.repeat(np.arange(len(size)), size)), np.uint64(1) << (at % 64).astype(np.uint64))
            of_kind = (numbers[:, None] % kinds == np.arange(kinds)).astype(np.float32)
            for k, j, chord in _searched(s, p, len(size) + 1, radius_m):
                hit = np.flatnonzero(_within(chord, radius_m, rounding))
                if not len(hit):
                    continue
                k, j = k[hit], j[hit]
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                held = np.stack([np.bitwise_or.reduceat(word[j], starts) for word in bits], axis=1)
                held = np.unpackbits(held.view(np.uint8), axis=1, bitorder="little")[:, : len(numbers)]
                row, col = np.nonzero((held > 0) & (np.cumsum(held, axis=1, dtype=np.int32) <= first))
                offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(starts)))].astype(np.int32)
                counts = np.rint(held.astype(np.float32) @ of_kind).astype(np.int64)
                place = a.select(["lat", "lng"]).take(pa.array(k[starts]))
                own = [*place.columns, pa.array(held.sum(axis=1, dtype=np.int64)), *(pa.array(counts[:, n]) for n in range(kinds))]
                firsts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[col].astype(np.int64)))
                parts.append(pa.Table.from_arrays([*own, firsts], schema=fields))
        return pa.concat_tables(parts)

    return _worked_off(sites.select("lat", "lng"), places.select("lat", "lng", "members"), radius_m, schema, work, whole=True).where("count > 0")
