"""The nearest tile by a hierarchy of cells against all tiles."""

import math
import random
import re

from pyspark.sql import functions as F

from smokelake.operators import tiles
from smokelake.plans import QUERIES

from .conftest import DATA


def _metres(lon1, lat1, lon2, lat2):
    return math.hypot((lon1 - lon2) * 111412.84 * math.cos(math.radians((lat1 + lat2) / 2)), (lat1 - lat2) * 111132.954)


def test_nearest_among_many(spark):
    """A dense town, scattered tiles, tiles of many degrees and points anywhere; every level of cells is used."""
    draw = random.Random(11)
    t = [(f"town{k % 7}", x, y, x + 0.002, y + 0.002) for k in range(1500) for x, y in [(121.5 + draw.random() * 0.05, 25.0 + draw.random() * 0.05)]]
    t += [(f"far{k}", x, y, x + draw.random(), y + draw.random()) for k in range(150) for x, y in [(draw.uniform(-179, 178), draw.uniform(-85, 84))]]
    t += [("wide", -30.0, -20.0, 40.0, 30.0), ("pole", -180.0, 80.0, 180.0, 90.0), ("tie_b", 10.0, -60.0, 11.0, -59.0), ("tie_a", 10.0, -60.0, 11.0, -59.0)]
    p = [(k, draw.uniform(-180, 180), draw.uniform(-90, 90)) for k in range(250)] + [(1000 + k, 121.5 + draw.random() * 0.06, 25.0 + draw.random() * 0.06) for k in range(150)]
    p += [(2000, 10.5, -61.0), (2001, 180.0, 90.0), (2002, -180.0, -90.0), (2003, 0.0, 0.0)]
    got = {r.point_id: r for r in tiles.nearest_submap(spark.createDataFrame(p, "point_id int, lon double, lat double"), spark.createDataFrame(t, "region string, west double, south double, east double, north double")).collect()}
    assert len(got) == len(p)
    for i, lon, lat in p:
        want = min((_metres(lon, lat, min(max(lon, w), e), min(max(lat, s), n)), _metres(lon, lat, (w + e) / 2, (s + n) / 2), r) for r, w, s, e, n in t)
        assert math.isclose(got[i].distance, want[0], rel_tol=1e-12, abs_tol=1e-9), i
        assert got[i].region == want[2] or want[0] > 0 and math.isclose(got[i].distance, want[0], rel_tol=1e-15), i
    assert got[2000].region == "tie_a"


def test_bounds_hold_every_tile(spark):
    """The least and greatest distances are on the right side of the true one for every tile within the bounds."""
    draw = random.Random(5)
    rows = []
    for _ in range(3000):
        w, s = draw.uniform(-180, 170), draw.uniform(-90, 80)
        e, n = w + draw.random() * 10, s + draw.random() * 10
        x0, x1 = sorted((draw.uniform(w, e), draw.uniform(w, e)))
        y0, y1 = sorted((draw.uniform(s, n), draw.uniform(s, n)))
        lon, lat = draw.uniform(-180, 180), draw.uniform(-90, 90)
        rows.append((w, s, e, n, lon, lat, _metres(lon, lat, min(max(lon, x0), x1), min(max(lat, y0), y1))))
    df = spark.createDataFrame(rows, "w double, s double, e double, n double, lon double, lat double, d double")
    near, far = tiles.distance_bounds(*[F.col(c) for c in ("lon", "lat", "w", "s", "e", "n")])
    assert df.filter((near > F.col("d")) | (far < F.col("d"))).count() == 0
    assert tiles.nearest_submap(df.select(F.lit(1).alias("point_id"), "lon", "lat").limit(1), df.select(F.lit("r").alias("region"), F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"))).first().region == "r"


def test_far_points_touch_few_cells(spark):
    """20,000 tiles around one town: a point on the other side of the earth meets a small share of them."""
    t = spark.range(20_000).select(F.concat(F.lit("r"), (F.col("id") % 50).cast("string")).alias("region"), (120 + F.col("id") % 200 / 100).alias("west"), (22 + F.floor(F.col("id") / 200) / 50).alias("south"))
    t = t.withColumns({"east": F.col("west") + 0.01, "north": F.col("south") + 0.02})
    p = spark.createDataFrame([(1, -60.0, -20.0), (2, 121.0, 23.0)], "point_id int, lon double, lat double")
    found = tiles.nearest_submap(p, t)
    found.collect()
    graph = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in graph and "NestedLoop" not in graph
    levels = []
    size = tiles.WIDE_CELL
    while not levels or levels[-1] > tiles.FEW_TILES:
        levels.append(tiles.cell_extremes(t, size).agg(F.max("tiles")).first()[0])
        size /= 4
    assert len(levels) > 3  # no level holds all tiles in one cell to the end


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_tiles_meet_without_broadcast(spark):
    """Many tiles of equal bounds and points at one place: the same tiles as by brute force, and no side is sent whole to the driver."""
    draw = random.Random(3)
    t = [(k, f"r{k % 5}", f"r{k % 5}/{k:03d}", x, y, x + 0.02 * (1 + k % 3), y + 0.02) for k in range(300) for x, y in [(121 + draw.randrange(8) / 100, 24 + draw.randrange(4) / 100)]]
    p = [(k, 121 + k % 7 / 60, 24 + k % 3 / 50) for k in range(60)] + [(7, 121.3, 24.1), (100, None, 24.0)]
    tile_rows = spark.createDataFrame(t, "tile_id int, region string, path string, west double, south double, east double, north double")
    point_rows = spark.createDataFrame(p, "point_id int, lon double, lat double")
    found = tiles.tiles_near(point_rows, tile_rows, 3000, 4)
    got = sorted((r.point_id, r["rank"], r.path) for r in found.collect())
    want = []
    for i in sorted({i for i, *_ in p}):
        near = sorted((_metres(lon, lat, min(max(lon, w), e), min(max(lat, s), n)), path) for j, lon, lat in p if j == i and lon is not None for _, _, path, w, s, e, n in t)
        want += [(i, k + 1, path) for k, (d, path) in enumerate(x for x in near if x[0] <= 3000) if k < 4]
    assert got == sorted(want)
    assert "Broadcast" not in _physical(found)


def test_regions_of_equal_places_without_broadcast(spark):
    t = [(f"r{k % 3}", 121 + k % 4 / 100, 24.0, 121.02 + k % 4 / 100, 24.02) for k in range(200)]
    p = [(k, 121 + k % 8 / 100 + 0.001, 24.01, 100.0, 0.0, -89.0, 0.0) for k in range(40)]
    found = tiles.select_regions(spark.createDataFrame(p, "photo_id int, lon double, lat double, alt double, yaw double, pitch double, roll double"), spark.createDataFrame(t, "region string, west double, south double, east double, north double"))
    for r in found.collect():
        lon = p[r.photo_id][1]
        want = sorted({region for region, w, _, e, _ in t if w <= lon <= e})
        assert r.regions == ",".join(want or ["r0", "r1", "r2"]) and (r.status == "unresolved_keep_all") == (not want)
    assert "BroadcastHashJoin" not in _physical(found)


def test_windows_without_broadcast(spark):
    assert "BroadcastHashJoin" not in _physical(QUERIES["c11_roi_window"](spark, DATA))


def test_mask_is_made_once(spark):
    """No row of tiles makes the mask of 65,536 cells anew."""
    plan = QUERIES["b23_match_pixel_to_geo"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
    assert all(line.lstrip(" +-").startswith(":") for line in plan.splitlines() if "lambdafunction" in line)  # in the subquery alone


def test_points_of_one_place_are_looked_up_once(spark):
    p = spark.createDataFrame([(k, 121.0 + k % 2, 24.0) for k in range(20)] + [(99, None, 24.0)], "point_id int, lon double, lat double")
    t = spark.createDataFrame([("b", 121.0, 23.0, 121.1, 23.1), ("a", 122.0, 24.0, 122.1, 24.1), ("a", 122.0, 24.0, 122.1, 24.1)], "region string, west double, south double, east double, north double")
    found = tiles.nearest_submap(p, t)
    assert {r.point_id: r.region for r in found.collect()} == {**{k: "ba"[k % 2] for k in range(20)}, 99: None}
    assert re.search(r"Aggregate \[lon#\w+, lat#\w+\], \[lon#\w+, lat#\w+", found._jdf.queryExecution().optimizedPlan().toString())


def test_mosaic_sorts_spread_cells(spark):
    rows = [(k % 3, 0, k, float(100 - k), k % 5 != 4) for k in range(30)] + [(7, 7, 1, 2.0, False), (8, 8, 1, None, True), (9, 9, 1, 3.0, True), (9, 9, 1, 4.0, True)]
    found = tiles.mosaic(spark.createDataFrame(rows, "tx int, ty int, tile_seq int, value double, valid boolean"))
    assert {(r.tx, r.ty): (r.value, r.covered) for r in found.collect()} == {(0, 0): (73.0, True), (1, 0): (72.0, True), (2, 0): (74.0, True), (7, 7): (None, False), (8, 8): (None, True), (9, 9): (4.0, True)}
    plan = _physical(found).split("== Initial Plan ==")[-1]
    assert plan.rindex("SortAggregate") < plan.index("Exchange")  # no sort below the exchange
