"""Landed census tables as a map: equal-area projection, state lookups and derived columns, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: The ellipsoid's larger axis in metres and its flattening, and the projection's origin and two standard parallels in degrees.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LON0, LAT0, LAT1, LAT2 = -96.0, 40.0, 20.0, 60.0

#: States by division and divisions by region, with the code, letters and name of each state.
DIVISIONS = {
    "New England": "09 CT Connecticut, 23 ME Maine, 25 MA Massachusetts, 33 NH New Hampshire, 44 RI Rhode Island, 50 VT Vermont",
    "Middle Atlantic": "34 NJ New Jersey, 36 NY New York, 42 PA Pennsylvania",
    "East North Central": "17 IL Illinois, 18 IN Indiana, 26 MI Michigan, 39 OH Ohio, 55 WI Wisconsin",
    "West North Central": "19 IA Iowa, 20 KS Kansas, 27 MN Minnesota, 29 MO Missouri, 31 NE Nebraska, 38 ND North Dakota, 46 SD South Dakota",
    "South Atlantic": "10 DE Delaware, 11 DC District of Columbia, 12 FL Florida, 13 GA Georgia, 24 MD Maryland, 37 NC North Carolina, 45 SC South Carolina, 51 VA Virginia, 54 WV West Virginia",
    "East South Central": "01 AL Alabama, 21 KY Kentucky, 28 MS Mississippi, 47 TN Tennessee",
    "West South Central": "05 AR Arkansas, 22 LA Louisiana, 40 OK Oklahoma, 48 TX Texas",
    "Mountain": "04 AZ Arizona, 08 CO Colorado, 16 ID Idaho, 30 MT Montana, 32 NV Nevada, 35 NM New Mexico, 49 UT Utah, 56 WY Wyoming",
    "Pacific": "02 AK Alaska, 06 CA California, 15 HI Hawaii, 41 OR Oregon, 53 WA Washington",
}
REGIONS = {"Northeast": ("New England", "Middle Atlantic"), "Midwest": ("East North Central", "West North Central"), "South": ("South Atlantic", "East South Central", "West South Central"), "West": ("Mountain", "Pacific")}
OUTLYING = {"72": ("PR", "Puerto Rico")}
RACES = ("White", "Black or African American", "Asian", "Hispanic or Latino")
LEVELS = ("state", "congressional_district")


def states() -> list[tuple[str, str, str, str | None, str | None]]:
    """(code, letters, name, region, division) of every state; what lies outside the regions has none."""
    home = {d: r for r, ds in REGIONS.items() for d in ds}
    rows = [(*x.strip().split(" ", 2), home[d], d) for d, listed in DIVISIONS.items() for x in listed.split(",")]
    return sorted([*rows, *((k, a, n, None, None) for k, (a, n) in OUTLYING.items())])


def lookup(code: Column, field: int) -> Column:
    """A field of the state whose code a column has: 1 letters, 2 name, 3 region, 4 division; null for unknown codes."""
    pairs = [(x[0], x[field]) for x in states() if x[field] is not None]
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in pairs for v in pair)), code)


_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _q(s, log=math.log):
    """The authalic function of a sine: areas of belts are its differences."""
    return (1 - _E2) * (s / (1 - _E2 * s * s) - log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def albers(lon: Column, lat: Column) -> Column:
    """(x, y) in metres of a point in degrees, by a conic projection that keeps areas."""
    m1, m2, q0, q1, q2 = _m(math.radians(LAT1)), _m(math.radians(LAT2)), *(_q(math.sin(math.radians(x))) for x in (LAT0, LAT1, LAT2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho = AXIS / n * F.sqrt(F.greatest(c - n * _q(F.sin(F.radians(lat)), F.log), F.lit(0.0)))
    turn = n * F.radians(lon - LON0)
    return G.point_of(rho * F.sin(turn), AXIS / n * math.sqrt(c - n * q0) - rho * F.cos(turn))


def projected(regions: DataFrame) -> DataFrame:
    """``regions`` with geometries in degrees put into metres, point by point."""
    return regions.withColumn("geom", G.map_points(F.col("geom"), lambda p: albers(p["x"], p["y"])))


def census_map(raw: DataFrame, population: bool = True, race: bool = False, poverty: bool = False, level: str = "state", simplify: float | None = None, contiguous: bool = True) -> DataFrame:
    """Census rows (region_id, STATE, geom in degrees, counts by name; CONGRESSIONAL_DISTRICT) as a map in metres, with lookups, shares and densities.

    Districts that are no place (ZZ) go.  ``contiguous`` leaves out Alaska, Hawaii and Puerto Rico, and
    of districts those of the District of Columbia too.  ``simplify`` is a tolerance in metres.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    held = projected(raw).withColumns({"State Abbreviation": lookup(F.col("STATE"), 1), "State Name": lookup(F.col("STATE"), 2), "Region": lookup(F.col("STATE"), 3), "Division": lookup(F.col("STATE"), 4)})
    out = ["AK", "HI", "PR"]
    if level != "state":
        held, out = held.where(F.col("CONGRESSIONAL_DISTRICT") != "ZZ"), [*out, "DC"]
    if contiguous:
        held = held.where(~F.coalesce(F.col("State Abbreviation").isin(out), F.lit(False)))
    if simplify is not None:
        from ..plans.cartograms import simplify as simplified

        held = simplified(held, simplify)
    new = {}
    if population:
        new |= {"Population (Millions)": F.col("Population") / 1e6, "Population Density": F.try_divide(F.col("Population"), G.area(F.col("geom")) / 1e6)}
    if poverty:
        new |= {f"{c} %": F.try_divide(F.col(c), F.col("Total Poverty")) for c in ("Below Poverty Level", "Above Poverty Level")}
    if race:
        new |= {f"{c} %": F.try_divide(F.col(c), F.col("Total Race")) for c in RACES}
    return held.withColumns(new) if new else held
