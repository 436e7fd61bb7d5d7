"""Map tiles: catalogue, spatial lookup by grid cells, windows, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .shared import materialize

#: Degrees of a grid cell (fixed value). A tile of more cells than MANY_CELLS goes to cells COARSER times as wide.
CELL, MANY_CELLS, COARSER = 0.05, 256, 64
#: Degrees of the cells in which the nearest tile is sought, from the widest, each a fourth of the one before; and tiles of a cell that need no narrower ones.
WIDE_CELL, LEVELS, FEW_TILES = 16.0, 9, 64


def tile_catalog(raw: DataFrame) -> DataFrame:
    """Tiles with region (first folder of the path) and the reason why a tile is rejected (null: accepted)."""
    parts = F.split("path", "/")
    det = (F.col("east") - F.col("west")) / F.col("width") * (F.col("north") - F.col("south")) / F.col("height")
    finite = F.lit(True)
    for c in ("west", "south", "east", "north"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    reason = (
        F.when(F.col("crs").isNull(), "missing_crs").when(~finite, "bounds_not_finite")
        .when((F.col("west") > F.col("east")) | (F.col("south") > F.col("north")), "bounds_reversed").when(F.abs(det) < 1e-20, "singular_transform")
    )
    return raw.withColumn("region", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("root")).withColumn("reason", reason)


def _cells(west, south, east, north, size: float) -> tuple[Column, Column, Column]:
    """Columns with the cells in x and y that an envelope meets, and their number."""
    at = lambda v: F.floor(F.col(v) / size).cast("int")
    n = (at(east) - at(west) + 1).cast("long") * (at(north) - at(south) + 1)
    return F.sequence(at(west), at(east)), F.sequence(at(south), at(north)), n


def lawful(tiles: DataFrame) -> DataFrame:
    """Tiles with finite bounds in order, within the range of coordinates."""
    ok = (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")) & (F.col("west") >= -360) & (F.col("east") <= 360) & (F.col("south") >= -90) & (F.col("north") <= 90)
    return tiles.filter(F.coalesce(ok, F.lit(False)))


def _near_pairs(points: DataFrame, tiles: DataFrame, size: float = CELL) -> DataFrame:
    """Points (with an envelope w, s, e, n) and the tiles whose bounds meet it.

    Both sides are spread over grid cells and meet by an equi-join; a pair counts in one cell only, the first that both
    share, so nothing is deduplicated by a shuffle. Tiles of very many cells do the same on a coarser grid. Neither side is
    broadcast: Spark estimates it by the rows before they are spread.
    """
    spread = lawful(tiles).withColumn("_many", _cells("west", "south", "east", "north", size)[2] > MANY_CELLS)
    meet = (F.col("east") >= F.col("w")) & (F.col("west") <= F.col("e")) & (F.col("north") >= F.col("s")) & (F.col("south") <= F.col("n"))
    out = None
    for many, cell in ((False, size), (True, size * COARSER)):
        x, y, _ = _cells("west", "south", "east", "north", cell)
        cells = spread.filter(F.col("_many") == many).withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))
        px, py, _ = _cells("w", "s", "e", "n", cell)
        seekers = points.withColumn("cx", F.explode(px)).withColumn("cy", F.explode(py))
        first = lambda a, b, c=cell: F.greatest(F.floor(F.col(a) / c), F.floor(F.col(b) / c))
        pairs = seekers.join(cells.hint("merge"), ["cx", "cy"]).filter(meet & (F.col("cx") == first("w", "west")) & (F.col("cy") == first("s", "south"))).drop("cx", "cy", "_many")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def tiles_near(points: DataFrame, tiles: DataFrame, radius: float, k: int, submap: str | None = None) -> DataFrame:
    """For each point the k tiles within the radius, by distance to their bounds, then path; distance and rank added.

    Points at one place are looked up once, and of tiles with the same bounds only the first k by path can be among the k.
    """
    tiles = tiles if submap is None else tiles.filter(F.col("region") == submap)
    tiles = lawful(tiles.select("tile_id", "region", "path", "west", "south", "east", "north"))
    alike = Window.partitionBy("west", "south", "east", "north").orderBy("path")
    tiles = tiles.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k).drop("_n")
    env = G.gps_envelope("lon", "lat", F.lit(float(radius)))
    places = points.select("lon", "lat").distinct().withColumn("_e", env).filter("_e.reason IS NULL")
    places = places.select("lon", "lat", F.col("_e.west").alias("w"), F.col("_e.south").alias("s"), F.col("_e.east").alias("e"), F.col("_e.north").alias("n"))
    near_lon = F.least(F.greatest("lon", "west"), F.col("east"))
    near_lat = F.least(F.greatest("lat", "south"), F.col("north"))
    rows = _near_pairs(places, tiles).withColumn("distance", G.geo_distance("lon", "lat", near_lon, near_lat)).filter(F.col("distance") <= radius)
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "path"))
    found = rows.withColumn("rank", first("lon", "lat")).filter(F.col("rank") <= k).drop("w", "s", "e", "n", "rank")
    rows = points.join(found.hint("merge"), ["lon", "lat"]).withColumn("rank", first("point_id")).filter(F.col("rank") <= k)
    return rows.select(*points.columns, *tiles.columns, "distance", "rank")


def region_bounds(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("region").agg(F.count("*").alias("tiles"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def cell_extremes(tiles: DataFrame, size: float) -> DataFrame:
    """Tiles by the grid cell of their centre: cx, cy, the number of tiles, and west, south, east and north of all of them."""
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / size).cast("int")
    return tiles.groupBy(at("west", "east").alias("cx"), at("south", "north").alias("cy")).agg(
        F.count("*").alias("tiles"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )


def distance_bounds(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The least and the greatest that geo_distance can be from a point to the nearest place of any tile within the bounds.

    The factor of a degree of longitude is the cosine of the mean latitude; over the latitudes of the bounds it is least at
    one end, and greatest at the other or at the equator.
    """
    low, high = (lat + south) / 2, (lat + north) / 2
    narrow = F.greatest(F.least(F.cos(F.radians(low)), F.cos(F.radians(high))), F.lit(0.0))
    broad = F.when((low <= 0) & (high >= 0), F.lit(1.0)).otherwise(F.greatest(F.cos(F.radians(low)), F.cos(F.radians(high))))
    zero = F.lit(0.0)
    near = F.hypot(F.greatest(west - lon, lon - east, zero) * G.METRES_LON * narrow, F.greatest(south - lat, lat - north, zero) * G.METRES_LAT)
    far = F.hypot(F.greatest(F.abs(lon - west), F.abs(lon - east)) * G.METRES_LON * broad, F.greatest(F.abs(lat - south), F.abs(lat - north)) * G.METRES_LAT)
    return near / G.WIDER, far * G.WIDER


def nearest_submap(points: DataFrame, tiles: DataFrame, key: str = "point_id") -> DataFrame:
    """For each point the region of the nearest tile bounds, then nearest tile centre, then name; null where the point has no place on the map, or where there is no tile.

    Tiles lie in a hierarchy of cells by their centres, each cell with the extremes of its tiles. A point begins at the widest cells
    (276 at most) and goes down only into those whose least possible distance is no more than the greatest possible distance of another
    cell; only in the last ones it meets tiles. So a point far from all tiles touches few cells, as does a near one. Levels end
    where no cell holds more than FEW_TILES tiles. Tiles without lawful bounds take no part. Points at one place are looked up once, and
    tiles of one region with the same bounds count once.
    """
    slim = materialize(lawful(tiles).select("region", "west", "south", "east", "north").distinct())
    bounds = ["west", "south", "east", "north"]
    levels, size = [], WIDE_CELL
    while True:
        levels.append(materialize(cell_extremes(slim, size)))
        if len(levels) == LEVELS or (levels[-1].agg(F.max("tiles")).first()[0] or 0) <= FEW_TILES:
            break
        size /= 4
    placed = points.filter(F.coalesce((F.abs("lon") <= 180) & (F.abs("lat") <= 90), F.lit(False))).select("lon", "lat").distinct()  # not a number is above all
    bound = lambda c: distance_bounds(F.col("lon"), F.col("lat"), *[c[b] for b in bounds])

    # the widest cells are few: each point sees them as one array, and only those that it keeps become rows
    roots = levels[0].agg(F.collect_list(F.struct("cx", "cy", *bounds))).scalar()
    rows = placed.withColumn("_all", roots).withColumn("_far", F.array_min(F.transform("_all", lambda c: bound(c)[1])))
    rows = rows.withColumn("c", F.explode(F.filter("_all", lambda c: bound(c)[0] <= F.col("_far")))).select("lon", "lat", "_far", "c.cx", "c.cy")
    for cells in levels[1:]:
        up = lambda c: F.floor(F.col(c) / 4).cast("int").alias(f"_{c}")
        below = cells.select(F.col("cx").alias("_x"), F.col("cy").alias("_y"), up("cx"), up("cy"), *bounds)
        found = rows.join(below, (rows["cx"] == below["_cx"]) & (rows["cy"] == below["_cy"])).drop("cx", "cy", "_cx", "_cy").withColumnsRenamed({"_x": "cx", "_y": "cy"})
        near, far = distance_bounds(F.col("lon"), F.col("lat"), *[F.col(b) for b in bounds])
        found = found.withColumns({"_near": near, "_far": F.least("_far", far)})
        found = found.withColumn("_far", F.min("_far").over(Window.partitionBy("lon", "lat"))).filter(F.col("_near") <= F.col("_far"))
        rows = found.select("lon", "lat", "_far", "cx", "cy")
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / size).cast("int")
    own = slim.withColumns({"cx": at("west", "east"), "cy": at("south", "north")})
    pairs = rows.join(own, ["cx", "cy"])
    near_lon, near_lat = F.least(F.greatest("lon", "west"), F.col("east")), F.least(F.greatest("lat", "south"), F.col("north"))
    edge = G.geo_distance("lon", "lat", near_lon, near_lat)
    centre = G.geo_distance("lon", "lat", (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    best = pairs.groupBy("lon", "lat").agg(F.min(F.struct(edge.alias("edge"), centre.alias("centre"), "region")).alias("b"))
    return points.select(key, "lon", "lat").join(best.hint("merge"), ["lon", "lat"], "left").select(key, "b.region", F.col("b.edge").alias("distance"))


def view_points(photos: DataFrame, reach: float = 1800.0) -> DataFrame:
    """Where the view's centre meets the ground (view_lon, view_lat); null where it doesn't go down or lies beyond the reach. Columns lon, lat, alt, yaw, pitch, roll."""
    r = G.camera_rotation("yaw", "pitch", "roll")
    rows = photos.withColumn("_f", F.slice(r, 7, 3))
    scale = -F.col("alt") / F.get("_f", F.lit(2))
    east, north = F.get("_f", F.lit(0)) * scale, F.get("_f", F.lit(1)) * scale
    ok = (F.get("_f", F.lit(2)) < -1e-6) & (F.col("alt") > 0) & (F.hypot(east, north) <= reach)
    p = G.to_gps(east, north, "lon", "lat")
    return rows.withColumns({"view_lon": F.when(ok, p["lon"]), "view_lat": F.when(ok, p["lat"])}).drop("_f")


def select_regions(photos: DataFrame, tiles: DataFrame, key: str = "photo_id") -> DataFrame:
    """Regions whose tiles contain the photo's place or the centre of its view, with a status; photos without any keep all regions.

    Photos whose place or view is the same spot are looked up once, with the regions of tiles of different bounds.
    """
    rows = view_points(photos)
    spots = rows.select(key, F.lit("gps").alias("kind"), "lon", "lat").unionByName(rows.filter("view_lon IS NOT NULL").select(key, F.lit("view").alias("kind"), F.col("view_lon").alias("lon"), F.col("view_lat").alias("lat")))
    places = spots.select("lon", "lat").distinct().withColumns({"w": F.col("lon"), "e": F.col("lon"), "s": F.col("lat"), "n": F.col("lat")})
    met = _near_pairs(places, tiles.select("region", "west", "south", "east", "north").distinct()).groupBy("lon", "lat").agg(F.collect_set("region").alias("at"))
    hits = spots.join(met.hint("merge"), ["lon", "lat"])
    of = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("at"))))))
    hits = hits.groupBy(key).agg(of("gps").alias("g"), of("view").alias("v"))
    out = photos.select(key).join(hits.hint("merge"), key, "left").withColumn("regions", F.array_sort(F.array_union("g", "v")))
    status = (
        F.when(F.col("regions").isNull() | (F.size("regions") == 0), "unresolved_keep_all").when(F.size("regions") > 1, "multiple_candidates")
        .when((F.size("g") > 0) & (F.size("v") > 0), "gps_and_view_candidate").when(F.size("g") > 0, "gps_bounds_candidate").otherwise("estimated_view_candidate")
    )
    every = lawful(tiles).agg(F.array_sort(F.collect_set("region")).alias("all")).scalar()
    regions = F.when(status == "unresolved_keep_all", every).otherwise(F.col("regions"))
    return out.select(key, F.array_join(regions, ",").alias("regions"), status.alias("status"))


def roi_window(pairs: DataFrame, size: float, radius: float) -> DataFrame:
    """Pixel window of each point and tile pair: the envelope of half the size around the point (moved into the tile) cut with the search envelope, clipped to the tile; null if empty."""
    anchor_lon, anchor_lat = F.least(F.greatest("lon", "west"), F.col("east")), F.least(F.greatest("lat", "south"), F.col("north"))
    rows = pairs.withColumns({"_a": G.gps_envelope(anchor_lon, anchor_lat, F.lit(size / 2)), "_b": G.gps_envelope("lon", "lat", F.lit(float(radius)))})
    w, s = F.greatest("_a.west", "_b.west"), F.greatest("_a.south", "_b.south")
    e, n = F.least("_a.east", "_b.east"), F.least("_a.north", "_b.north")
    sx, sy = (F.col("east") - F.col("west")) / F.col("width"), (F.col("north") - F.col("south")) / F.col("height")
    x0 = F.greatest(F.floor((w - F.col("west")) / sx), F.lit(0))
    x1 = F.least(F.ceil((e - F.col("west")) / sx), F.col("width"))
    y0 = F.greatest(F.floor((F.col("north") - n) / sy), F.lit(0))
    y1 = F.least(F.ceil((F.col("north") - s) / sy), F.col("height"))
    ok = (w < e) & (s < n) & (x1 > x0) & (y1 > y0)
    return rows.withColumns({"col": F.when(ok, x0), "row": F.when(ok, y0), "cols": F.when(ok, x1 - x0), "rows": F.when(ok, y1 - y0)}).drop("_a", "_b")


def mosaic(cells: DataFrame) -> DataFrame:
    """One value for each target cell: of the last tile that is valid there; covered tells whether any is.

    The largest struct is found by sorting, so cells are spread first: else a task sorts all cells of the tiles that it reads.
    """
    valid = F.when(F.col("valid"), F.struct("tile_seq", "value"))
    return cells.repartition("tx", "ty").groupBy("tx", "ty").agg(F.max(valid)["value"].alias("value"), F.max("valid").alias("covered"))


def percentile_stretch(cells: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values of each region stretched from its percentiles to whole numbers 0 to 255 (cut off, not rounded); all 0 where it is flat."""
    bounds = cells.groupBy("region").agg(F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(high)).alias("hi"))
    v = F.least(F.greatest((F.col("value") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(255.0))
    return cells.join(bounds, "region").withColumn("level", F.when(F.col("hi") > F.col("lo"), F.floor(v + 1e-9)).otherwise(0).cast("int")).drop("lo", "hi")


def catalog_fingerprint(tiles: DataFrame) -> DataFrame:
    """One stable hash for each region's list of path, size, time and origin: the hash of the hashes of its parts by the path's hash, in order."""
    line = F.concat_ws("|", "path", F.col("size_bytes").cast("string"), F.col("mtime").cast("string"), F.floor(F.col("west") * 1000 + 0.5).cast("string"), F.floor(F.col("north") * 1000 + 0.5).cast("string"))
    part = F.substring(F.md5("path"), 1, 3)
    digest = lambda lines: F.sha2(F.array_join(F.array_sort(lines), ";"), 256)
    parts = tiles.groupBy("region", part.alias("part")).agg(digest(F.collect_list(line)).alias("digest"))
    return parts.groupBy("region").agg(digest(F.collect_list(F.concat_ws(":", "part", "digest"))).alias("fingerprint"))
