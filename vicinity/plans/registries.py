"""What categories, metrics and grid layers there are. Fixed values throughout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules
from ..operators.quality import TableSpec

SITE_COLUMNS = ("name", "gu", "dong", "lat", "lng")


@dataclass(frozen=True)
class Category:
    """One baseline: how places are counted around a site, and which metric is scored.

    ``radii`` get a count each; ``subtypes`` (value -> column stem) are counted within
    ``subtype_radius``; item lists hold the nearest ``items`` within ``item_radius``. ``rounding`` says
    whether whole metres or raw distances are compared. ``unbounded`` asks for the nearest place
    however far.
    """

    key: str
    metric: str
    better: str = "higher"
    radii: tuple[int, ...] = ()
    subtypes: dict[str, str] = field(default_factory=dict)
    subtype_radius: int = 0
    item_radius: int = 0
    items: int = 0
    rounding: str = "before"
    unbounded: bool = False
    ranked: bool = True

    @property
    def radius_rules(self) -> list[tuple[str, str]]:
        names = [f"{self.key}_count_{r}m" for r in sorted(self.radii)]
        return list(zip(names, names[1:]))

    def spec(self) -> TableSpec:
        """What the data-quality job checks."""
        return TableSpec(
            self.key, required=[*SITE_COLUMNS, self.metric], primary_metric=self.metric,
            json_columns=["items_json"] if self.items else [], radius_rules=self.radius_rules,
            percent_columns=[f"{self.metric}_pct", f"{self.metric}_score"],
        )


def _brands(category: str) -> dict[str, str]:
    return {name: name for name, _ in rules.BRAND_RULES[category]}


CATEGORIES = {
    c.key: c
    for c in [
        Category("subway", "subway_count_500m", radii=(500, 800, 1000), item_radius=1500, items=20),
        Category("bus", "bus_count_500m", radii=(300, 500), rounding="after", unbounded=True),
        Category("bike", "bike_count_500m", radii=(300, 500), item_radius=500, items=20),
        Category("convenience", "convenience_count_500m", radii=(300, 500), subtypes=_brands("convenience"), subtype_radius=500, item_radius=500, items=9999),
        Category("large_mart", "large_mart_count_3000m", radii=(3000,), subtypes={b: b for b in rules.MART_GROUPS["large_mart"][1]}, subtype_radius=3000, item_radius=3000, items=40),
        Category("super_mart", "super_mart_count_500m", radii=(500,), subtypes={b: b for b in rules.MART_GROUPS["super_mart"][1]}, subtype_radius=500, item_radius=500, items=40),
        Category("warehouse_mart", "warehouse_mart_count_5000m", radii=(5000,), subtypes={b: b for b in rules.MART_GROUPS["warehouse_mart"][1]}, subtype_radius=5000, item_radius=5000, items=40),
        Category("cafe", "cafe_access_raw", radii=(300, 500), subtypes=_brands("cafe"), subtype_radius=500, item_radius=500, items=9999),
        Category("medical", "medical_count_1000m", radii=(500, 1000), subtypes={n: n for n, _ in rules.HOSPITAL_SPECIALTIES}, subtype_radius=500, item_radius=1000, items=40, rounding="after"),
        Category("academy", "academy_count_1000m", radii=(500, 1000), subtypes={n: n for n, _ in rules.ACADEMY_RULES} | {"기타": "기타"}, subtype_radius=1000, item_radius=1000, items=30),
        Category("culture", "culture_count_1500m", radii=(1500,), subtypes={n: n for n, _ in rules.CULTURE_RULES}, subtype_radius=1500, item_radius=1500, items=30, rounding="after"),
        Category("shopping", "shopping_count_3000m", radii=(3000,), subtypes={k: k for k in ("백화점", "쇼핑몰", "시장", "전문점", "기타쇼핑")}, subtype_radius=3000, item_radius=3000, items=30),
        Category("commercial", "commercial_count_1000m", radii=(1000,), subtypes={v: v for v in rules.COMMERCIAL_TYPES.values()}, subtype_radius=1000, item_radius=1000, items=30),
        Category("nightlife", "nightlife_count_500m", "lower", radii=(500, 1000), subtypes={n: n for n, _ in rules.NIGHTLIFE_RULES} | {"기타": "기타"}, subtype_radius=1000, item_radius=1000, items=30),
        Category("hangang", "nearest_distance", "lower", radii=(3000,), item_radius=3000, items=12),
        Category("fire_station", "nearest_distance", "lower", radii=(3000,), subtypes={n: n for n, _ in rules.FIRE_RULES}, subtype_radius=3000, item_radius=3000, items=12),
        Category("ev_charger", "ev_charger_count_500m", radii=(300, 500, 1000), item_radius=1000, items=40),
        Category("cctv", "cctv_count_500m", radii=(300, 500)),
        Category("park", "nearest_distance", "lower", unbounded=True, ranked=False),
        Category("school_zone", "elementary_access_score", ranked=False),
    ]
}


@dataclass(frozen=True)
class Layer:
    """A grid layer: metres of influence, trust, and whether its source lists every place.

    Samples taken around sites (``census=False``) would paint the grid where sites are, and are refused.
    """

    key: str
    radius_m: int
    trust: str
    has_nearest: bool = False
    census: bool = True


LAYERS = {
    x.key: x
    for x in [
        Layer("academy", 1000, "medium"), Layer("school", 500, "high", True), Layer("child_zone", 300, "high", True),
        Layer("hospital", 500, "medium", True), Layer("pharmacy", 500, "medium", True), Layer("subway", 500, "high", True),
        Layer("bus_stop", 500, "high"), Layer("bike", 500, "high"), Layer("ev_charger", 1000, "medium"),
        Layer("cctv", 200, "normalized"),
        Layer("mart", 3000, "sample", census=False), Layer("cafe", 500, "sample", census=False),
        Layer("convenience", 500, "sample", census=False),
    ]
}


def layer_radius(keys=None) -> dict[str, int]:
    """Radius per layer, refusing layers that are samples."""
    wanted = [LAYERS[k] for k in keys] if keys is not None else [x for x in LAYERS.values() if x.census]
    samples = [x.key for x in wanted if not x.census]
    if samples:
        raise ValueError(f"sampled around sites, not usable on the grid: {samples}")
    return {x.key: x.radius_m for x in wanted}


def layer_table(spark: SparkSession) -> DataFrame:
    rows = [(x.key, x.radius_m, x.trust, x.has_nearest) for x in LAYERS.values() if x.census]
    return spark.createDataFrame(rows, "layer string, radius_m int, trust string, has_nearest boolean")


def metric_table(spark: SparkSession) -> DataFrame:
    rows = [(c.key, c.metric, c.better, c.ranked) for c in CATEGORIES.values()]
    return spark.createDataFrame(rows, "category string, metric string, better string, ranked boolean")
