"""JSON item lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import col

ITEM_SCHEMA = "array<struct<label: string, name: string, distance: double, subtype: string, lat: double, lng: double>>"


def parse_items(text, schema: str = ITEM_SCHEMA) -> Column:
    """The list ordered by distance (items without one last); broken or blank text gives an empty list."""
    items = F.from_json(col(text), schema, {"mode": "PERMISSIVE"})
    usable = F.try_parse_json(col(text)).isNotNull()
    by_distance = lambda a, b: (
        F.when(F.coalesce(a["distance"], F.lit(999999.0)) < F.coalesce(b["distance"], F.lit(999999.0)), -1)
        .when(F.coalesce(a["distance"], F.lit(999999.0)) > F.coalesce(b["distance"], F.lit(999999.0)), 1)
        .otherwise(0)
    )
    return F.coalesce(F.when(usable, F.array_sort(items, by_distance)), F.array().cast(schema))
