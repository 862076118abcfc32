"""Polygon helpers for zone coverage (G1, G2) as native column expressions.

A zone polygon arrives as WKT.  ``parse_polygon_wkt`` turns it into rings of
(x, y) points; ``polygon_edges`` flattens every ring into one edge array (built
once per polygon, not per point).  ``covers`` is the boundary-inclusive
point-in-polygon test of PostGIS ``ST_Covers``: a point on any ring edge is
covered; otherwise even-odd crossing parity over all rings decides, so a point
inside a hole is not covered but a point on the hole's edge is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.cols import as_col

_POLYGON = r"^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$"


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn`` (keeps the expression tree small)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def parse_polygon_wkt(wkt) -> Column:
    """WKT POLYGON -> array<array<struct<x,y>>> (outer ring first); NULL if not a valid polygon.

    A ring must have at least four points and be closed (first point = last point).
    """
    body = F.regexp_extract(F.upper(as_col(wkt)), _POLYGON, 1)

    def parse(b: Column) -> Column:
        tokens = F.transform(
            F.split(b, r"\)\s*,\s*\("),
            lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+")),
        )

        def check_and_build(rt: Column) -> Column:
            ring_ok = lambda ring: (
                (F.size(ring) >= 4)
                & F.forall(ring, lambda t: (F.size(t) == 2) & t[0].try_cast("double").isNotNull()
                           & t[1].try_cast("double").isNotNull())
                & (F.transform(F.element_at(ring, 1), lambda v: v.try_cast("double"))
                   == F.transform(F.element_at(ring, -1), lambda v: v.try_cast("double")))
            )
            rings = F.transform(rt, lambda ring: F.transform(
                ring, lambda t: F.struct(t[0].try_cast("double").alias("x"), t[1].try_cast("double").alias("y"))))
            return F.when((b != "") & F.forall(rt, ring_ok), rings)

        return let(tokens, check_and_build)

    return let(body, parse)


def ring_to_wkt(rings) -> Column:
    """Rings back to canonical WKT text (ST_AsText form: 'POLYGON((x y,x y,...),(...))')."""
    def num(c: Column) -> Column:
        # integral coordinates print without a fraction, as ST_AsText does
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))

    ring_txt = F.transform(
        as_col(rings),
        lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat(num(p["x"]), F.lit(" "), num(p["y"]))), ","), F.lit(")")),
    )
    return F.concat(F.lit("POLYGON("), F.array_join(ring_txt, ","), F.lit(")"))


def polygon_edges(rings) -> Column:
    """All ring edges as array<struct<ax, ay, bx, by>>."""
    def ring_edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.zip_with(
            F.slice(ring, 1, n - 1),
            F.slice(ring, 2, n - 1),
            lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
        )

    return F.flatten(F.transform(as_col(rings), ring_edges))


def bbox(rings) -> Column:
    """struct<minx, miny, maxx, maxy> of the outer ring."""
    outer = F.element_at(as_col(rings), 1)
    xs = F.transform(outer, lambda p: p["x"])
    ys = F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _on_edge(e: Column, px: Column, py: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
    return (
        (cross == 0)
        & (px >= F.least(e["ax"], e["bx"])) & (px <= F.greatest(e["ax"], e["bx"]))
        & (py >= F.least(e["ay"], e["by"])) & (py <= F.greatest(e["ay"], e["by"]))
    )


def _crosses(e: Column, px: Column, py: Column) -> Column:
    straddles = (e["ay"] > py) != (e["by"] > py)
    x_at = (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
    return straddles & (px < x_at)


def covers(edges, px, py) -> Column:
    """Boundary-inclusive point-in-polygon over a precomputed edge array."""
    ed, x, y = as_col(edges), as_col(px), as_col(py)
    on_boundary = F.exists(ed, lambda e: _on_edge(e, x, y))
    crossings = F.size(F.filter(ed, lambda e: _crosses(e, x, y)))
    return on_boundary | (crossings % 2 == 1)
