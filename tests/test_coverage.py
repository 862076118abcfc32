"""Point in polygon: boundary inclusive, holes excluded but their edges covered; newest assignment wins."""

import datetime as dt

from mercato.operators import coverage

SQUARE_WITH_HOLE = "POLYGON((0 0,8 0,8 8,0 8,0 0),(2 2,6 2,6 6,2 6,2 2))"
TRIANGLE = "POLYGON((10 0,18 0,14 8,10 0))"


def _run(spark, points, sz_rows):
    zones = spark.createDataFrame([(1, 1, "square", SQUARE_WITH_HOLE), (2, 1, "triangle", TRIANGLE), (3, 1, "bad", "LINESTRING(0 0,1 1)")],
                                  "id long, area_id long, name string, coordinates_wkt string")
    areas = spark.createDataFrame([(1, "north", "Karachi")], "id long, name string, city string")
    branches = spark.createDataFrame([(7, 0, "b7")], "id long, merchant_id long, name string")
    sz = spark.createDataFrame(sz_rows, "id long, merchant_id long, zone_id long, branch_id long, created_at timestamp")
    pts = spark.createDataFrame(points, "id long, merchant_id long, lon double, lat double")
    return {r.id: r for r in coverage.zone_coverage(pts, sz, zones, areas, branches).collect()}


def test_edges_and_holes(spark):
    t = dt.datetime(2024, 1, 1)
    got = _run(spark, [(1, 0, 8.0, 4.0), (2, 0, 4.0, 4.0), (3, 0, 2.0, 4.0), (4, 0, 1.0, 1.0), (5, 0, 9.0, 9.0),
                       (6, 0, 14.0, 8.0), (7, 0, 12.0, 4.0), (8, 1, 1.0, 1.0)],
               [(100, 0, 1, 7, t), (101, 0, 2, None, t), (102, 0, 3, None, t)])
    assert got[1].covered and got[1].zone_id == 1          # on the outer edge
    assert not got[2].covered                               # inside the hole
    assert got[3].covered and got[3].zone_id == 1          # on the hole's edge
    assert got[4].covered and got[4].branch_name == "b7"
    assert not got[5].covered
    assert got[6].covered and got[6].zone_id == 2          # triangle apex
    assert got[7].covered and got[7].branch_name == ""     # on the triangle's left edge, no branch
    assert not got[8].covered                               # other merchant has no zones


def test_newest_assignment_wins(spark):
    got = _run(spark, [(1, 0, 1.0, 1.0)],
               [(100, 0, 1, None, dt.datetime(2024, 1, 1)), (99, 0, 1, 7, dt.datetime(2024, 1, 2)),
                (98, 0, 1, None, dt.datetime(2024, 1, 2))])
    assert got[1].covered and got[1].branch_id is None     # newest, then lowest id (98)


def test_covering_is_exact_up_to_its_edge_cells(spark):
    """Points in inside cells are covered, points in no cell are not, cells of one zone do not overlap; sizes from a metre to a continent."""
    shapes = {1: SQUARE_WITH_HOLE, 2: TRIANGLE, 3: "POLYGON((0 0,0.00001 0,0.00001 0.00001,0 0.00001,0 0))", 4: "POLYGON((-180 -90,180 -90,180 90,-180 90,-180 -90))",
              5: "POLYGON((-3.7 -1.2,4.1 0.3,-2.2 5.9,-3.7 -1.2))", 6: "LINESTRING(0 0,1 1)", 7: "POLYGON((1 1,1 1,1 1,1 1))"}
    zones = spark.createDataFrame([(i, 1, "z", w) for i, w in shapes.items()], "id long, area_id long, name string, coordinates_wkt string")
    import random

    rng = random.Random(4)
    for splits in (0, 1, 2, 3):
        cells = {}
        for r in coverage.covering(coverage.parsed_zones(zones), splits).collect():
            cells.setdefault(r.zone_id, []).append((2.0 ** r.k, r.cx, r.cy, r.inside))
        assert set(cells) == {1, 2, 3, 4, 5, 7} and all(len(c) <= 4 * 16 ** splits for c in cells.values())
        for i in (1, 2, 3, 4, 5):
            rings = [[tuple(map(float, p.split())) for p in ring.split(",")] for ring in shapes[i][9:-2].split("),(")]
            xs, ys = [x for x, _ in rings[0]], [y for _, y in rings[0]]
            for _ in range(300):
                x, y = rng.uniform(min(xs) - 0.1, max(xs) + 0.1), rng.uniform(min(ys) - 0.1, max(ys) + 0.1)
                at = [inside for side, cx, cy, inside in cells[i] if x // side == cx and y // side == cy]
                assert len(at) <= 1
                assert _brute_covers(rings, x, y) == (at[0] or _brute_covers(rings, x, y) if at else False)


def test_wide_and_many_vertex_polygons(spark):
    """A zone 10,000 times as wide as the others and one with 2,000 vertices take the same path."""
    import math

    t = dt.datetime(2024, 1, 1)
    star = [(50 + (5 + i % 2) * math.cos(2 * math.pi * i / 2000), 50 + (5 + i % 2) * math.sin(2 * math.pi * i / 2000)) for i in range(2000)]
    star.append(star[0])
    wide = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
    small = [(1.0, 1.0), (1.01, 1.0), (1.01, 1.01), (1.0, 1.01), (1.0, 1.0)]
    polys = {1: wide, 2: star, 3: small}
    zones = spark.createDataFrame([(i, 1, f"z{i}", _wkt([p])) for i, p in polys.items()], "id long, area_id long, name string, coordinates_wkt string")
    areas = spark.createDataFrame([(1, "north", "Karachi")], "id long, name string, city string")
    branches = spark.createDataFrame([], "id long, merchant_id long, name string")
    sz = spark.createDataFrame([(100 + i, 0, i, None, t + dt.timedelta(days=i)) for i in polys], "id long, merchant_id long, zone_id long, branch_id long, created_at timestamp")
    import random

    rng = random.Random(2)
    pts = [(i, 0, rng.uniform(43, 57), rng.uniform(43, 57)) for i in range(300)] + [(500, 0, 1.005, 1.0), (501, 0, 99.0, 1.0), (502, 0, 101.0, 1.0)]
    pts += [(None, 0, 1.0, 1.0), (None, 0, 2.0, 2.0), (503, None, 2.0, 2.0), (504, 0, None, 2.0), (505, 0, float("nan"), 2.0), (501, 0, 99.0, 1.0)]
    rows = coverage.zone_coverage(spark.createDataFrame(pts, "id long, merchant_id long, lon double, lat double"), sz, zones, areas, branches).collect()
    assert len(rows) == len(pts)
    for r in rows:
        ok = r.merchant_id == 0 and r.lon is not None and r.lon == r.lon
        want = max([i for i, p in polys.items() if ok and _brute_covers([p], r.lon, r.lat)], default=None)
        assert (r.zone_id, r.covered) == (want, want is not None)


def test_no_zones(spark):
    empty = "id long, merchant_id long, zone_id long, branch_id long, created_at timestamp"
    zones = spark.createDataFrame([(1, 1, "bad", "POINT(1 1)")], "id long, area_id long, name string, coordinates_wkt string")
    areas = spark.createDataFrame([(1, "north", "Karachi")], "id long, name string, city string")
    branches = spark.createDataFrame([], "id long, merchant_id long, name string")
    pts = spark.createDataFrame([(1, 0, 1.0, 1.0)], "id long, merchant_id long, lon double, lat double")
    (row,) = coverage.zone_coverage(pts, spark.createDataFrame([], empty), zones, areas, branches).collect()
    assert not row.covered and row.zone_id is None


def _brute_covers(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def _wkt(rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def test_random_points_match_brute_force(spark):
    import random

    rng = random.Random(11)
    zones, sz, polys = [], [], {}
    for zid in range(12):
        x0, y0 = rng.randint(0, 10), rng.randint(0, 10)
        w, h = rng.randint(2, 6), rng.randint(2, 6)
        outer = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0 + w // 2, y0 + h + 2), (x0, y0 + h), (x0, y0)]
        rings = [outer]
        if w >= 4 and h >= 4:
            rings.append([(x0 + 1, y0 + 1), (x0 + 2, y0 + 1), (x0 + 2, y0 + 2), (x0 + 1, y0 + 2), (x0 + 1, y0 + 1)])
        polys[zid] = rings
        zones.append((zid, 1, f"z{zid}", _wkt(rings)))
        for m in (0, 1):
            if (zid + m) % 3:
                sz.append((100 * m + zid, m, zid, None, dt.datetime(2024, 1, 1 + (zid * 7 + m) % 3)))
    pts = [(i, i % 2, rng.randint(0, 40) / 2, rng.randint(0, 40) / 2) for i in range(400)]
    expected = {}
    for pid, m, x, y in pts:
        cands = [(-(s[4].timestamp()), s[0], s[2]) for s in sz if s[1] == m and _brute_covers(polys[s[2]], x, y)]
        expected[pid] = min(cands)[2] if cands else None
    zdf = spark.createDataFrame(zones, "id long, area_id long, name string, coordinates_wkt string")
    areas = spark.createDataFrame([(1, "a", "Karachi")], "id long, name string, city string")
    branches = spark.createDataFrame([], "id long, merchant_id long, name string")
    sdf = spark.createDataFrame(sz, "id long, merchant_id long, zone_id long, branch_id long, created_at timestamp")
    pdf = spark.createDataFrame(pts, "id long, merchant_id long, lon double, lat double")
    for splits in (0, 1, 2):  # first cells only, finer ones
        got = {r.id: r.zone_id for r in coverage.zone_coverage(pdf, sdf, zdf, areas, branches, splits=splits).collect()}
        assert got == expected
