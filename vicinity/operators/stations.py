"""Roll-ups of raw facility rows: chargers to stations, platforms to stations, park facilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text as tx
from ..functions.geo import CITY_BOUNDS, EARTH_RADIUS_M, METRES_PER_DEG, half_even, in_bounds
from ..session import cut
from .graph import merge_labels

# Charger tokens and codes.
DELETED_WORDS, CLOSED_WORDS = ["삭제", "폐쇄", "사용불가"], ["폐쇄", "운영중지", "사용불가", "삭제"]
FAST_WORDS, FAST_CODES, FAST_KW = ["DC", "콤보", "차데모", "급속"], ["01", "03", "04", "05", "06"], 50
OPEN_WORDS, SHUT_WORDS = ["N", "0", "FALSE", "없음", "제한없음"], ["제한", "전용", "관계자", "입주민", "회원"]
YES = ["Y", "1", "TRUE"]
CLUSTER_RADIUS_M = 350


def _upper(*names: str) -> Column:
    return F.upper(F.coalesce(tx.first_of(*names), F.lit("")))


def in_city(address, zone_code, lat, lng) -> Column:
    """Address names the city, or the zone code is the city's, or the point is in its box."""
    named = F.coalesce(F.col(address).contains("서울"), F.lit(False))
    coded = F.coalesce(F.col(zone_code).startswith("11"), F.lit(False))
    return named | coded | in_bounds(lat, lng, CITY_BOUNDS)


def is_closed(deleted, status, status_text) -> Column:
    gone = _upper(deleted)
    shown = F.coalesce(tx.clean(status_text), F.lit(""))
    return (
        gone.isin(YES)
        | rules.contains_any(gone, DELETED_WORDS)
        | F.coalesce(tx.clean(status) == "4", F.lit(False))
        | rules.contains_any(shown, CLOSED_WORDS)
    )


def is_fast(kind, output, method) -> Column:
    words = F.upper(rules.joined(kind, method))
    return (
        F.coalesce(tx.number(output) >= FAST_KW, F.lit(False))
        | rules.contains_any(words, FAST_WORDS)
        | F.coalesce(tx.clean(kind).isin(FAST_CODES), F.lit(False))
    )


def is_restricted(limited, detail) -> Column:
    said = _upper(limited, detail)
    return F.when(said.isin(OPEN_WORDS), False).when(said.isin(YES), True).otherwise(
        rules.contains_any(said, SHUT_WORDS)
    )


def is_free_parking(value) -> Column:
    return _upper(value).isin(*YES, "무료") | _upper(value).contains("무료")


def is_available(status, status_text) -> Column:
    shown = F.coalesce(tx.clean(status_text), F.lit(""))
    return F.coalesce(tx.clean(status) == "2", F.lit(False)) | rules.contains_any(shown, ["충전대기", "사용가능"])


def charger_stations(rows: DataFrame) -> DataFrame:
    """Chargers rolled up to stations with seven counters and the set of types.

    ``rows``: ``station_id, name, address, lat, lng, operator, use_time, kind`` and the booleans
    ``fast, restricted, free, available``. Without an id, name and place identify a station.
    """
    place = F.concat_ws("|", "name", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lng"))
    keyed = rows.withColumn("station", F.coalesce(tx.clean("station_id"), place))
    place_of = ["name", "address", "lat", "lng", "operator", "use_time"]
    rolled = keyed.groupBy("station").agg(
        F.min(F.struct(*place_of)).alias("_row"),  # one real row, never a mixture
        F.count("*").alias("charger_count"),
        F.count_if("fast").alias("fast_count"), F.count_if(~F.col("fast")).alias("slow_count"),
        F.count_if("restricted").alias("restricted_count"), F.count_if(~F.col("restricted")).alias("public_count"),
        F.count_if("free").alias("free_parking_count"), F.count_if("available").alias("available_count"),
        F.array_join(F.array_sort(F.collect_set(tx.clean("kind"))), ", ").alias("charger_types"),
    )
    counters = [c for c in rolled.columns if c not in ("station", "_row")]
    return rolled.select("station", *(f"_row.{c}" for c in place_of), *counters)


def charger_access(near_300, near_500, near_1k, fast_1k, public_1k, restricted_1k) -> Column:
    """0..100 from the nearest ring with a station, numbers, and a deduction for closed ones."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    base = F.when(c(near_300) > 0, 45).when(c(near_500) > 0, 35).when(c(near_1k) > 0, 20).otherwise(0)
    score = (
        base
        + F.least(c(near_500), F.lit(5)) * 5
        + F.least(c(fast_1k), F.lit(10)) * 2
        + F.least(c(public_1k), F.lit(10))
        - F.least(c(restricted_1k), F.lit(10)) * 2
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def access_level(score) -> Column:
    return rules.banded(score, [(75, "높음"), (55, "좋음"), (30, "보통")], "낮음")


def inside_complex(site_name, station_name, address) -> Column:
    """The site's name (three letters or more) occurs in the station's name or address."""
    name = tx.normalize_match(site_name)
    station = tx.normalize_match(F.concat_ws(" ", F.col(station_name), F.col(address)))
    return (F.length(name) >= 3) & F.contains(station, name)


def station_pieces(rows: DataFrame, radius_m: float = CLUSTER_RADIUS_M) -> DataFrame:
    """``rows`` with ``piece``: parts of a name that no station can span.

    A running mean of ``n`` rows lies within ``radius_m`` of the row that joined last (it moved towards it by an ``n``-th
    of at most that). So the next row to join is within twice the radius of an earlier one, and a station never leaves
    the rows that chain together over such steps. Cells as wide as a step hold a row and all its links in themselves
    and their eight neighbours: a piece is a connected group of cells of one name, found without any pair of rows.
    """
    step = (2 * radius_m + 5) * 1.001 / METRES_PER_DEG
    farthest = rows.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    columns = max(1, math.floor(360 * math.cos(math.radians(min(farthest + step, 89.9))) / step))
    row, column = F.floor(F.col("lat") / step), F.pmod(F.floor(F.col("lng") * (columns / 360)), F.lit(columns))
    placed = rows.withColumns({"_row": F.coalesce(row, F.lit(0)), "_column": F.coalesce(column, F.lit(0))})
    keys = ["name", "_row", "_column"]
    cells = cut(placed.select(*keys).distinct().withColumn("cell", F.monotonically_increasing_id()))
    beside = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = cells.select("name", F.col("cell").alias("u"), "_row", "_column", F.explode(beside).alias("d")).select(
        "name", "u", (F.col("_row") + F.col("d.i")).alias("_row"), F.pmod(F.col("_column") + F.col("d.j"), F.lit(columns)).alias("_column")
    )
    same = [near[c].eqNullSafe(cells[c]) for c in keys]
    links = near.join(cells, same[0] & same[1] & same[2]).select("u", F.col("cell").alias("v"))
    roots = merge_labels(links)
    named = cells.join(roots, F.col("cell") == F.col("node"), "left").select(
        *(F.col(c).alias(f"{c}_") for c in keys), F.coalesce("root", "cell").alias("piece")
    )
    same = [placed[c].eqNullSafe(named[f"{c}_"]) for c in keys]
    return placed.join(named, same[0] & same[1] & same[2]).select(*rows.columns, "piece")


def cluster_stations(rows: DataFrame, radius_m: float = CLUSTER_RADIUS_M) -> DataFrame:
    """Platforms of one name within the radius of a running centre become one station.

    A row joins the station of its name that was begun first among those whose centre is within the radius, else it
    begins one; so the result depends on the order of rows (``ord``). Names are taken apart into pieces that don't
    touch each other (``station_pieces``), and a piece is walked in order: rows are shuffled by piece, sorted by Spark,
    and streamed in Arrow batches. A task holds the stations of one piece, filed by cells, so a row looks at those
    nearby. ``seq`` numbers the stations of a name in the order of their first rows.
    ``rows``: ``ord, station_id, name, line, lat, lng``; rows without coordinates belong to no station, and
    places on both sides of the date line don't meet.
    """
    schema = "name string, first long, lat double, lng double, n long, lines array<string>, ids array<string>"
    usable = rows.select("name", F.col("ord").cast("long").alias("ord"), "station_id", "line", "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL")
    ordered = station_pieces(cut(usable), radius_m).repartition("piece").sortWithinPartitions("piece", "ord", "station_id", "line", "lat", "lng")
    made = ordered.mapInPandas(_cluster_batches(radius_m), schema)
    number = F.row_number().over(Window.partitionBy("name").orderBy("first")) - 1
    return made.select(
        "name", number.cast("int").alias("seq"), "lat", "lng", "n", F.array_sort("lines").alias("lines"), F.array_sort("ids").alias("ids"),
        (F.size("lines") >= 2).alias("is_transfer"),
    )


def _cluster_batches(radius_m: float):
    tall = (radius_m + 1) / METRES_PER_DEG

    def metres(lat1, lng1, lat2, lng2):
        a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
        a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
        return round(2 * EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)))

    class Piece:
        """Stations of one piece, filed by cells at least as wide as the radius."""

        def __init__(self, lat):
            self.wide = tall / math.cos(math.radians(min(abs(lat) + 1, 89.9)))
            self.stations, self.filed, self.reach = [], {}, abs(lat) + 1

        def cell(self, lat, lng):
            return math.floor(lat / tall), math.floor(lng / self.wide)

        def home(self, lat, lng):
            if abs(lat) > self.reach:  # the piece goes on towards a pole: wider cells
                self.reach, self.wide = abs(lat) + 1, tall / math.cos(math.radians(min(abs(lat) + 1, 89.9)))
                self.filed = {}
                for k, c in enumerate(self.stations):
                    self.filed.setdefault(self.cell(c["lat"], c["lng"]), set()).add(k)
            i, j = self.cell(lat, lng)
            near = (k for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for k in self.filed.get((a, b), ()))
            return min((k for k in near if metres(self.stations[k]["lat"], self.stations[k]["lng"], lat, lng) <= radius_m), default=None)

        def add(self, row):
            k = self.home(row.lat, row.lng)
            if k is None:
                k = len(self.stations)
                self.stations.append({"name": row.name, "first": row.ord, "lat": row.lat, "lng": row.lng, "n": 0, "lines": set(), "ids": set()})
                self.filed.setdefault(self.cell(row.lat, row.lng), set()).add(k)
            c = self.stations[k]
            c["n"] += 1
            if c["n"] > 1:
                old = self.cell(c["lat"], c["lng"])
                c["lat"] += (row.lat - c["lat"]) / c["n"]
                c["lng"] += (row.lng - c["lng"]) / c["n"]
                if (new := self.cell(c["lat"], c["lng"])) != old:
                    self.filed[old].discard(k)
                    self.filed.setdefault(new, set()).add(k)
            c["lines"].add(row.line)
            if row.station_id:
                c["ids"].add(row.station_id)

        def done(self):
            return [{**c, "lines": sorted(x for x in c["lines"] if x is not None), "ids": sorted(c["ids"])} for c in self.stations]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, piece = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.piece != number:
                    done += piece.done() if piece else []
                    number, piece = row.piece, Piece(row.lat)
                piece.add(row)
            if done:
                yield pd.DataFrame(done)
        if piece:
            yield pd.DataFrame(piece.done())

    return run


def park_facilities(rows: DataFrame) -> DataFrame:
    """Facilities rolled up per park: total, count per group, primary group, display tags.

    ``rows``: ``park, facility, count``. Tags are decided per distinct facility name, so the
    grouped lists stay as small as the rule table.
    """
    named = rows.where("park <> '' AND facility <> '' AND count > 0")
    grouped = named.withColumns(
        {
            "group": rules.facility_group("facility"),
            "_tags": rules.all_matches("facility", rules.FACILITY_TAGS),
        }
    )
    per_group = grouped.groupBy("park", "group").agg(F.sum("count").alias("n"))
    totals = per_group.groupBy("park").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "n")))).alias("groups"),
    )
    tags = grouped.select("park", F.explode("_tags").alias("tag")).groupBy("park").agg(
        F.collect_set("tag").alias("_set")
    )
    order = [label for label, _ in rules.FACILITY_TAGS]
    shown = F.slice(rules.by_priority(F.coalesce("_set", F.array().cast("array<string>")), order), 1, rules.FACILITY_TAGS_SHOWN)
    return totals.join(tags, "park", "left").select(
        "park", "total", "groups",
        rules.primary_facility_group(F.map_keys("groups")).alias("primary_group"), shown.alias("tags"),
    )
