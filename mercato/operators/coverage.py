"""Zones and delivery coverage.

Coverage (G2) replaces a PostGIS GIST lookup with a hierarchical cell index built by Spark:

1. every zone's polygon is parsed once (WKT -> rings -> edge array, bounding box)
   and covered by cells of several sizes (``covering``): the cells of the bounding
   box are split in 4 x 4 as long as an edge runs through them, ``splits`` times.
   A cell that no edge touches lies inside as a whole or is left out.  The work
   and the number of cells follow the shape, not the size, of the polygon;
2. the sizes are powers of two, so that a point's cell is exact arithmetic; a point
   has one cell per size in use and does one equi join on (merchant, size, cell);
3. a hit in an inside cell needs no edge.  Hits in edge cells are joined with the
   edges of their zone and tested exactly;
4. the winning zone per point is a minimum over its hits.

The keys have a high cardinality: a merchant holding most points still spreads
over many cells, and AQE splits a hot cell or zone.  No task holds a list of polygons.

The winning zone per point is the covering assignment with the newest
created_at, then the lowest id; a point with none is ``covered = false``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.cols import first_reason, unmet
from mercato.functions.geo import bbox, covers, let, parse_polygon_wkt, polygon_edges, ring_to_wkt
from mercato.operators.hours import CITIES
from mercato.session import materialize

SPLIT_BITS = 2  # a split halves a cell's side this often
SMALLEST = -20  # exponent of the smallest first cell, about 0.1 m in degrees


def _floor(x, k):
    """Number of the cell of side 2^k that holds coordinate x; division by a power of two is exact."""
    return F.floor(x / F.pow(F.lit(2.0), k))


def _meets(e, x0, y0, side):
    """May edge ``e`` run through the closed square at (x0, y0)?  In doubt yes: such a cell is tested point by point."""
    x1, y1 = x0 + side, y0 + side
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    near = F.lit(1e-9) * (F.abs(dx) + F.abs(dy))  # far above the rounding of degrees
    corners = [dx * (y - e["ay"]) - dy * (x - e["ax"]) for x in (x0, x1) for y in (y0, y1)]
    apart = (F.greatest(*corners) < -near) | (F.least(*corners) > near)
    return ((F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0)
            & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0) & ~apart)


def covering(parsed: DataFrame, splits: int = 2) -> DataFrame:
    """Cells of side 2^k that cover the valid zones of ``parsed_zones``: zone_id, k, cx, cy, inside.

    No two cells of a zone overlap.  ``inside``: the zone covers the whole cell;
    otherwise an edge may run through it.  Row by row, nothing is shuffled.
    """
    extent = F.greatest(F.col("bbox.maxx") - F.col("bbox.minx"), F.col("bbox.maxy") - F.col("bbox.miny"))
    first = F.ceil(F.log2(F.greatest(extent, F.lit(2.0 ** SMALLEST))) / SPLIT_BITS).cast("int") * SPLIT_BITS  # few sizes are in use
    k, side = F.col("k"), F.pow(F.lit(2.0), F.col("k"))
    z = parsed.filter("is_valid").select(F.col("id").alias("zone_id"), "edges", "bbox", first.alias("k"))
    cells = z.select("zone_id", "edges", "k", "bbox", F.explode(F.sequence(_floor(F.col("bbox.minx"), k), _floor(F.col("bbox.maxx"), k))).alias("cx"))
    cells = cells.select("zone_id", "edges", "k", "cx", F.explode(F.sequence(_floor(F.col("bbox.miny"), k), _floor(F.col("bbox.maxy"), k))).alias("cy"))
    cells = cells.withColumn("inside", F.lit(None).cast("boolean"))
    for step in range(splits + 1):
        if step:
            n = 1 << SPLIT_BITS
            parts = F.array(*[F.struct((k - SPLIT_BITS).alias("k"), (F.col("cx") * n + i).alias("cx"), (F.col("cy") * n + j).alias("cy"),
                                       F.lit(None).cast("boolean").alias("inside")) for i in range(n) for j in range(n)])
            whole = F.array(F.struct("k", "cx", "cy", "inside"))
            cells = cells.select("zone_id", "edges", F.inline(F.when(F.col("inside"), whole).otherwise(parts)))
        x0, y0 = F.col("cx") * side, F.col("cy") * side
        cut = F.exists("edges", lambda e: _meets(e, x0, y0, side))
        cells = cells.withColumn("_cut", F.when(F.col("inside"), F.lit(False)).otherwise(cut))
        cells = cells.where(F.col("_cut") | F.coalesce("inside", covers("edges", x0 + side / 2, y0 + side / 2))).withColumn("inside", ~F.col("_cut")).drop("_cut")
    return cells.select("zone_id", "k", "cx", "cy", "inside")


def list_service_zones(service_zones: DataFrame, zones: DataFrame, areas: DataFrame, branches: DataFrame) -> DataFrame:
    """Service zones with zone, area and branch names (branch_name '' when none)."""
    extra = [c for c in ("is_valid", "edges", "bbox") if c in zones.columns]
    z = zones.select(F.col("id").alias("zone_id"), F.col("area_id"), F.col("name").alias("zone_name"), "coordinates_wkt", *extra)
    a = areas.select(F.col("id").alias("area_id"), F.col("name").alias("area_name"), F.col("city").alias("area_city"))
    b = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("_bname"))
    return (service_zones.join(z, "zone_id").join(a, "area_id").join(b, "branch_id", "left")
            .withColumn("branch_name", F.coalesce("_bname", F.lit(""))).drop("_bname"))


def list_areas_zones(zones: DataFrame, areas: DataFrame) -> DataFrame:
    """G4 (+G1): zones with their area; polygon parsed and written back as canonical WKT."""
    geo = let(parse_polygon_wkt(F.col("coordinates_wkt")),
              lambda rings: F.struct(rings.isNotNull().alias("is_valid"),
                                     F.when(rings.isNotNull(), ring_to_wkt(rings)).alias("coordinates_wkt")))
    a = areas.select(F.col("id").alias("area_id"), F.col("name").alias("area_name"), F.col("city").alias("area_city"))
    return zones.join(a, "area_id").withColumn("_geo", geo).select(
        F.col("id").alias("zone_id"), F.col("name").alias("zone_name"), "area_id", "area_name", "area_city",
        "_geo.is_valid", "_geo.coordinates_wkt",
    )


def parsed_zones(zones: DataFrame) -> DataFrame:
    """G1 once per zone: rings, edge array and bounding box (edges empty when the WKT is not a polygon)."""
    geo = let(parse_polygon_wkt(F.col("coordinates_wkt")), lambda rings: F.struct(
        rings.isNotNull().alias("is_valid"), F.coalesce(polygon_edges(rings), F.array()).alias("edges"),
        bbox(rings).alias("bbox")))
    return zones.withColumn("_geo", geo).select(*zones.columns, "_geo.is_valid", "_geo.edges", "_geo.bbox")


def zone_coverage(points: DataFrame, service_zones: DataFrame, zones: DataFrame, areas: DataFrame, branches: DataFrame, splits: int = 2) -> DataFrame:
    """For each point (id, merchant_id, lon, lat) the covering service zone, or covered = false.

    ``splits`` says how finely edges are followed; the result does not depend on it.
    Points that agree in all four columns have the same zone; each row comes out once.
    """
    info = ["zone_id", "branch_id", "zone_name", "branch_name", "area_id", "area_name", "area_city"]
    # each zone is parsed and covered once; written, so that the parser's long expression is not planned into every later step
    parsed = materialize(parsed_zones(zones).select("id", "is_valid", "edges", "bbox"))
    cells = materialize(covering(parsed, splits))
    assigned = list_service_zones(service_zones, zones, areas, branches).select("merchant_id", "created_at", "id", *info)
    index = cells.join(assigned.select("merchant_id", "zone_id", "created_at", F.col("id").alias("assignment")), "zone_id")
    sizes = sorted(r["k"] for r in cells.select("k").distinct().collect())  # some ten numbers
    where = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("lon") / F.lit(2.0 ** k)).alias("cx"), F.floor(F.col("lat") / F.lit(2.0 ** k)).alias("cy"))
                                for k in sizes]) if sizes else F.expr("array_repeat(struct(0 AS k, 0L AS cx, 0L AS cy), 0)"))
    own = ["id", "merchant_id", "lon", "lat"]
    placed = points.select(*own).distinct().where("NOT isnan(lon) AND NOT isnan(lat)").select(*own, where.alias("c")).select(*own, "c.*")
    near = placed.join(index, ["merchant_id", "k", "cx", "cy"]).select(*own, "zone_id", "created_at", "assignment", "inside")
    edges = parsed.select(F.col("id").alias("zone_id"), "edges")
    on_edge = near.where("NOT inside").join(edges, "zone_id").where(covers("edges", "lon", "lat"))
    hits = near.where("inside").drop("inside").unionByName(on_edge.drop("inside", "edges"))
    best = hits.groupBy(*own).agg(F.min_by("assignment", F.struct(-F.unix_micros("created_at"), "assignment")).alias("assignment"))
    best = best.join(assigned.select(F.col("id").alias("assignment"), *info), "assignment")
    best = best.select("assignment", *info, *[F.col(c).alias(f"_{c}") for c in own])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    return points.select(*own).join(best, same, "left").select(*own, F.col("assignment").isNotNull().alias("covered"), *info)


def validate_zone_batch(batch: DataFrame, areas: DataFrame) -> DataFrame:
    """Zone rows (area_id, name, coordinates_wkt): name and WKT required, area exists, WKT is a polygon."""
    a = areas.select(F.col("id").alias("area_id"), F.lit(True).alias("_area"))
    j = batch.join(a, "area_id", "left")
    reason = first_reason(
        ((F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce(F.trim("coordinates_wkt"), F.lit("")) == ""), "required"),
        (F.col("_area").isNull(), "area_not_found"),
        (parse_polygon_wkt(F.col("coordinates_wkt")).isNull(), "invalid_polygon"),
    )
    return j.withColumn("reason", reason).drop("_area")


def validate_service_zone_batch(batch: DataFrame, zones: DataFrame, branches: DataFrame) -> DataFrame:
    """(merchant_id, zone_id, branch_id) rows: zone exists; branch exists in the tenant."""
    z = zones.select(F.col("id").alias("zone_id"), F.lit(True).alias("_zone"))
    b = branches.select(F.col("id").alias("branch_id"), F.col("merchant_id").alias("_bm"))
    j = batch.join(z, "zone_id", "left").join(b, "branch_id", "left")
    reason = first_reason(
        (F.col("_zone").isNull(), "zone_not_found"),
        (F.col("branch_id").isNotNull() & (F.col("_bm").isNull() | (F.col("_bm") != F.col("merchant_id"))), "branch_not_found"),
    )
    return j.withColumn("reason", reason).drop("_zone", "_bm")


def validate_point_batch(points: DataFrame) -> DataFrame:
    """Latitude in [-90, 90] and longitude in [-180, 180], both given."""
    reason = first_reason(
        (unmet(F.col("lat").between(-90, 90)), "invalid_latitude"),
        (unmet(F.col("lon").between(-180, 180)), "invalid_longitude"),
    )
    return points.withColumn("reason", reason)


def validate_area_batch(batch: DataFrame) -> DataFrame:
    """Area name required, city in the fixed set."""
    reason = first_reason(
        (F.coalesce(F.trim("name"), F.lit("")) == "", "required"),
        (~F.coalesce(F.col("city").isin(*CITIES), F.lit(False)), "invalid_city"),
    )
    return batch.withColumn("reason", reason)
