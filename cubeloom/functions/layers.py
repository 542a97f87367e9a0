"""Boundary layers and how each layer's feature code maps to a classification code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per layer the feature property that holds the code and what is
# subtracted from it; ``landsdele`` goes through the code map instead.
LAYER_CODES = {
    "kommuner": ("kode", 0),
    "regioner": ("kode", 1000),
    "politikredse": ("kode", 1459),
    "retskredse": ("kode", 0),
    "sogne": ("kode", 0),
    "postnumre": ("nr", 0),
    "storkredse": ("nummer", 0),
    "valgkredse": ("kode", 0),
    "afstemningsomraader": ("dagi_id", 0),
}
MAPPED_LAYER = "landsdele"
NUTS3_CODES = {
    "DK011": 1,
    "DK012": 2,
    "DK013": 3,
    "DK014": 4,
    "DK021": 5,
    "DK022": 6,
    "DK031": 7,
    "DK032": 8,
    "DK041": 10,
    "DK042": 9,
    "DK050": 11,
}


def layer_key(layer: Column) -> Column:
    """Classification code of a feature; null for an unknown layer."""
    mapped = F.create_map(*[F.lit(v) for pair in NUTS3_CODES.items() for v in pair])
    out = F.when(layer == MAPPED_LAYER, mapped[F.col("nuts3")].cast("bigint"))
    for name, (field, offset) in LAYER_CODES.items():
        out = out.when(layer == name, F.col(field).cast("bigint") - offset)
    return out
