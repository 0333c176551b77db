"""Priors of places and points of interest, and settlement rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACE_BASE = {"city": 6.0, "borough": 4.5, "municipality": 4.0, "town": 3.5, "suburb": 2.5, "quarter": 2.0, "village": 2.0, "neighbourhood": 1.5, "hamlet": 1.2, "isolated_dwelling": 1.0}
POI_PRIOR = {
    7.0: ["aeroway=aerodrome"],
    5.5: ["railway=station", "public_transport=station"],
    5.0: ["amenity=hospital", "amenity=university", "natural=peak", "natural=volcano", "natural=glacier", "natural=bay", "waterway=river", "natural=water"],
    4.5: ["historic=castle", "tourism=museum", "tourism=zoo", "tourism=theme_park"],
    4.0: ["railway=halt", "amenity=bus_station", "amenity=townhall", "amenity=college", "tourism=attraction"],
    3.5: ["natural=wood", "natural=beach", "natural=island", "natural=cape", "natural=spring", "waterway=waterfall", "mountain_pass=yes", "natural=saddle", "natural=cliff", "natural=cave_entrance", "amenity=theatre", "amenity=cinema", "tourism=gallery", "historic=monument", "leisure=stadium", "amenity=library"],
    3.0: ["amenity=school", "amenity=place_of_worship", "leisure=park", "amenity=police", "amenity=post_office", "railway=tram_stop"],
    2.5: ["tourism=hotel", "amenity=pharmacy", "amenity=fuel", "shop=supermarket", "shop=mall", "amenity=marketplace"],
}
RANK = {"city": 6.0, "town": 5.0, "village": 4.0, "suburb": 3.0, "borough": 3.0, "quarter": 2.0, "neighbourhood": 2.0}
CATCHMENT_KM = {"city": 15.0, "borough": 10.0, "municipality": 8.0, "town": 6.0, "village": 2.5, "suburb": 2.5, "quarter": 1.5, "neighbourhood": 1.2, "hamlet": 1.2, "isolated_dwelling": 0.4}


def lookup(key: Column, values: dict[str, float], default: float | None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default).cast("double"))


def place_prior(place_type: Column, population: Column) -> Column:
    return lookup(place_type, PLACE_BASE, 1.0) + F.when(population > 0, F.log10(population)).otherwise(0.0)


def poi_prior(category: Column) -> Column:
    return lookup(category, {c: p for p, cs in POI_PRIOR.items() for c in cs}, 1.8)


def settlement_rank(place_type: Column, population: Column) -> Column:
    """Which of two mappings of one settlement is the better: its class, then its people. No prior."""
    return F.coalesce(population, F.lit(0)) / F.lit(1e6) + lookup(place_type, RANK, 1.0)
