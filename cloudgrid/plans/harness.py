"""Queries over the driver's tables and the SQL that each is held against.

The tables hold no geometry: ``pts`` and the other views below are made of their keys by arithmetic that is exact in doubles, with the
same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.lineage import settle
from ..operators import graphs, images, points, surfaces, tiles3d, voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LEVEL, SIZE = 5, 32
#: edge of the rasters
G = 64

PTS = """pts AS (SELECT cast((l_partkey * 7919 + l_linenumber * 104729) % 4096 AS double) / 4096 AS x, cast((l_orderkey * 6151) % 4096 AS double) / 4096 AS y,
  l_quantity / 64 AS z, l_extendedprice AS inten FROM lineitem),
fpts AS (SELECT *, cast(floor(x * 6) * 6 + floor(y * 6) AS int) AS file_id FROM pts)"""
VOX = f"""{PTS}, vox AS (SELECT cast(floor(x * {SIZE}) AS int) AS x, cast(floor(y * {SIZE}) AS int) AS y, cast(floor(z * {SIZE}) AS int) AS z, count(*) AS n
  FROM pts WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1 AND z >= 0 AND z < 1 GROUP BY 1, 2, 3)"""
GRID = f"grid AS (SELECT cast(a.r AS int) AS y, cast(b.r AS int) AS x FROM range({G}) a(r), range({G}) b(r))"
MAP = f"""{PTS}, {GRID}, top AS (SELECT cast(least(greatest(floor(y * {G} + 0.5), 0), {G - 1}) AS int) AS y, cast(least(greatest(floor(x * {G} + 0.5), 0), {G - 1}) AS int) AS x, max(z) AS v FROM pts GROUP BY 1, 2),
img AS (SELECT grid.y, grid.x, coalesce(v, 0::double) AS v, CASE WHEN v IS NULL THEN 0::double ELSE 1::double END AS w FROM grid LEFT JOIN top USING (y, x))"""
BOXES = f"{PTS}, files AS (SELECT file_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM fpts GROUP BY file_id)"


def query(sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{sql}" if not sql.lstrip().startswith("SELECT") else sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Points of lineitem; only the columns that are asked for are read."""
    t = table(spark, d, "lineitem")
    p = t.select(
        (F.expr("(l_partkey * 7919 + l_linenumber * 104729) % 4096").cast("double") / 4096.0).alias("x"),
        (F.expr("(l_orderkey * 6151) % 4096").cast("double") / 4096.0).alias("y"),
        (F.col("l_quantity") / 64.0).alias("z"),
        F.col("l_extendedprice").alias("inten"),
    )
    p = p.withColumn("file_id", (F.floor(F.col("x") * 6.0) * 6 + F.floor(F.col("y") * 6.0)).cast("int"))
    return p.select("x", "y", "z", *more)


def vox(spark, d, level: int = LEVEL) -> DataFrame:
    return voxels.voxelize(pts(spark, d), level).select("x", "y", "z", "n", F.col("n").cast("double").alias("val"))


def img(spark, d) -> DataFrame:
    return voxels.heightmap(pts(spark, d), G)


def files(spark, d) -> DataFrame:
    return pts(spark, d, "file_id").groupBy("file_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# --- points, tiles, transforms ----------------------------------------------------------------------------------------------------


@query(f"{PTS} SELECT x, y, z, inten FROM pts WHERE z >= 0.25 AND z < 0.5")
def filter_z(spark, d):
    p = pts(spark, d, "inten")
    return points.confine_z(p.withColumn("z", (F.col("z") - 0.25) * 4)).withColumn("z", F.col("z") / 4 + 0.25)


@query(f"{PTS} SELECT x, y, z FROM pts WHERE x >= 0.25 AND x <= 0.5 AND y >= 0.125 AND y <= 0.75")
def area_filter(spark, d):
    return points.area(pts(spark, d), 0.25, 0.125, 0.5, 0.75)


@query(f"{PTS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY x, y, z, inten) AS r FROM fpts) SELECT x, y, z, inten, file_id FROM n WHERE (r - 1) % 8 = 0")
def stride_sample(spark, d):
    return points.stride_sample(pts(spark, d, "inten", "file_id"), 8, "file_id", ["x", "y", "z", "inten"])


@query(f"{PTS}, q AS (SELECT quantile_cont(x, [0.2, 0.8]) AS qx, quantile_cont(y, [0.2, 0.8]) AS qy, quantile_cont(z, [0.0015, 0.9985]) AS qz FROM pts) SELECT x, y, z FROM pts, q WHERE x > qx[1] AND x < qx[2] AND y > qy[1] AND y < qy[2] AND z > qz[1] AND z < qz[2]")
def quantile_trim(spark, d):
    return points.quantile_trim(pts(spark, d), {"x": (0.2, 0.8), "y": (0.2, 0.8), "z": (0.0015, 0.9985)})


@query(f"{PTS}, q AS (SELECT quantile_cont(x, [0.05, 0.95]) AS qx, quantile_cont(y, [0.05, 0.95]) AS qy, quantile_cont(z, [0.0000001, 0.99995]) AS qz FROM pts), e AS (SELECT *, greatest(qx[2] - qx[1], qy[2] - qy[1], qz[2] - qz[1]) AS e FROM q), s AS (SELECT (x - qx[1]) / e AS x, (y - qy[1]) / e AS y, (z - qz[1]) / e AS z FROM pts, e) SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s WHERE x > 0 AND x < 1 AND y > 0 AND y < 1 AND z > 0 AND z < 1")
def quantile_window(spark, d):
    return points.quantile_window(pts(spark, d)).select(*r6("x", "y", "z"))


_EXT = "e AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM pts)"


@query(f"{PTS}, {_EXT} SELECT round((x - lx) * (0.99999 / greatest(hx - lx, hy - ly, hz - lz)), 6) AS x, round((y - ly) * (0.99999 / greatest(hx - lx, hy - ly, hz - lz)), 6) AS y, round((z - lz) * (0.99999 / greatest(hx - lx, hy - ly, hz - lz)), 6) AS z FROM pts, e")
def normalize_unit(spark, d):
    return points.normalize_unit(pts(spark, d)).select(*r6("x", "y", "z"))


@query(f"{PTS}, {_EXT}, m AS (SELECT *, greatest(hx - lx, hy - ly, hz - lz) AS m FROM e) SELECT round((x - lx) / m * 2 - 1, 6) AS x, round((y - ly) / m * 2 - 1, 6) AS y, round((z - lz) / m * 2 - 1, 6) AS z FROM pts, m")
def normalize_signed(spark, d):
    return points.normalize_signed(pts(spark, d)).select(*r6("x", "y", "z"))


@query(f"{PTS}, {_EXT}, m AS (SELECT *, greatest(hx, hy, hz) AS h FROM e) SELECT round((x - lx) / (h - lx + 0.0001), 6) AS x, round((y - ly) / (h - ly + 0.0001), 6) AS y, round((z - lz) / (h - lz + 0.0001), 6) AS z FROM pts, m")
def normalize_per_axis(spark, d):
    return points.normalize_per_axis(pts(spark, d)).select(*r6("x", "y", "z"))


_AFFINE = (100.0, 0.5, 0.25, 200.0, -0.25, 0.5)


@query(f"{PTS} SELECT x, y, 100 + x * 0.5 + y * 0.25 AS nx, 200 + x * -0.25 + y * 0.5 AS ny, round(x, 6) AS bx, round(y, 6) AS by_ FROM pts")
def affine_roundtrip(spark, d):
    p = pts(spark, d)
    nx, ny = points.affine(F.col("x"), F.col("y"), _AFFINE)
    p = p.withColumns({"nx": nx, "ny": ny})
    bx, by = points.affine(F.col("nx"), F.col("ny"), points.affine_inverse(_AFFINE))
    return p.select("x", "y", "nx", "ny", F.round(bx, 6).alias("bx"), F.round(by, 6).alias("by_"))


@query(f"{PTS}, u AS (SELECT x * 8192 AS ux, y * 8192 AS uy FROM pts) SELECT ux, uy, cast(floor(ux / 10000000 * 8192) AS int) AS tx, cast(floor(uy / 10000000 * 8192) AS int) AS ty, cast(ceil(ux / 10000000 * 8192) AS int) AS hx, cast(ceil(uy / 10000000 * 8192) AS int) AS hy, floor(ux / 10000000 * 8192) * 1220.703125 AS x0, (floor(ux / 10000000 * 8192) + 1) * 1220.703125 AS x1, ux / 10000000 AS cx FROM u")
def tile_assign(spark, d):
    u = pts(spark, d).select((F.col("x") * 8192.0).alias("ux"), (F.col("y") * 8192.0).alias("uy"))
    e = points.tile_edge(S.BASE_LEVEL)
    t = {n: points.tile_of(F.col(c), S.BASE_LEVEL, high) for n, c, high in (("tx", "ux", False), ("ty", "uy", False), ("hx", "ux", True), ("hy", "uy", True))}
    return u.withColumns(t).select("*", (F.col("tx") * e).alias("x0"), ((F.col("tx") + 1) * e).alias("x1"), (F.col("ux") / S.CHART).alias("cx"))


@query(f"{PTS} SELECT cast(floor(x * 4096) AS bigint) AS rx, round(cast(floor(x * 4096) AS bigint) * 0.25 - (1000 - 1024), 6) AS x, round(cast(floor(z * 64) AS bigint) * 0.5 + 3, 6) AS z FROM pts")
def las_rescale(spark, d):
    p = pts(spark, d).select(F.floor(F.col("x") * 4096.0).alias("rx"), F.floor(F.col("z") * 64.0).alias("rz"))
    return points.las_rescale(p, {"x": "rx", "z": "rz"}, {"x": 0.25, "z": 0.5}, {"x": 1024.0, "z": 3.0}, {"x": 1000.0}).select("rx", *r6("x", "z"))


@query(f"{PTS}, l AS (SELECT DISTINCT x * 360 - 180 AS lon, y * 160 - 80 AS lat FROM pts), m AS (SELECT lon, lat, radians(lon) * 6378137 AS mx, ln(tan(0.7853981633974483 + radians(lat) / 2)) * 6378137 AS my FROM l) SELECT lon, lat, round(mx, 3) AS mx, round(my, 3) AS my, cast(floor(degrees(mx / 6378137) * 1000 + 0.37) AS bigint) AS blon, cast(floor(degrees(2 * atan(exp(my / 6378137)) - 1.5707963267948966) * 1000 + 0.37) AS bigint) AS blat FROM m")
def mercator(spark, d):
    p = pts(spark, d).select((F.col("x") * 360.0 - 180.0).alias("lon"), (F.col("y") * 160.0 - 80.0).alias("lat")).distinct()
    p = p.withColumns({"mx": S.mercator_x(F.col("lon")), "my": S.mercator_y(F.col("lat"))})
    return p.select("lon", "lat", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.floor(S.mercator_lon(F.col("mx")) * 1000 + 0.37).alias("blon"), F.floor(S.mercator_lat(F.col("my")) * 1000 + 0.37).alias("blat"))


@query(f"{BOXES} SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM files")
def extent_union(spark, d):
    return points.extent(files(spark, d))


_PAIRS = f"{BOXES}, t AS (SELECT a.r AS tx, b.r AS ty, a.r / 8.0::double AS x0, b.r / 8.0::double AS y0 FROM range(8) a(r), range(8) b(r)), pairs AS (SELECT file_id, cast(tx AS bigint) AS tx, cast(ty AS bigint) AS ty FROM files, t WHERE min_x <= x0 + 0.125 AND max_x >= x0 AND min_y <= y0 + 0.125 AND max_y >= y0)"


@query(f"{_PAIRS} SELECT * FROM pairs")
def tile_file_overlap(spark, d):
    return points.tile_file_pairs(files(spark, d), 0.125).select("file_id", "tx", "ty")


@query(f"{_PAIRS} SELECT tx, ty, count(*) AS n, string_agg(cast(file_id AS varchar), ',' ORDER BY file_id) AS files FROM pairs GROUP BY tx, ty")
def files_per_tile(spark, d):
    t = points.files_per_tile(points.tile_file_pairs(files(spark, d), 0.125), "file_id")
    return t.select("tx", "ty", "n", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


@query(f"{_PAIRS} SELECT fpts.file_id, x, y, z FROM fpts JOIN pairs ON pairs.file_id = fpts.file_id WHERE tx = 3 AND ty = 2 AND x >= 0.375 AND x <= 0.5 AND y >= 0.25 AND y <= 0.375")
def tile_load(spark, d):
    pairs = points.tile_file_pairs(files(spark, d), 0.125)
    return points.tile_points(pts(spark, d, "file_id"), pairs, 3, 2, 0.125, "file_id").select("file_id", "x", "y", "z")


@query(f"{MAP} SELECT round(p.x, 6) AS x, round(p.y, 6) AS y, p.z, i.v FROM pts p JOIN img i ON i.x = cast(floor(p.x * {G}) AS int) AND i.y = cast(floor(p.y * {G}) AS int)")
def color_lookup(spark, d):
    return points.gather_pixels(pts(spark, d), img(spark, d), G, G).select(*r6("x", "y"), "z", "v")


@query("l AS (SELECT cast(r AS int) AS lvl FROM range(4) t(r)), n AS (SELECT lvl, cast((1000 // (1 << lvl) + 255) // 256 AS int) AS nx, cast((700 // (1 << lvl) + 255) // 256 AS int) AS ny FROM l), a AS (SELECT lvl, nx, unnest(range(ny)) AS by_ FROM n), b AS (SELECT lvl, by_, unnest(range(nx)) AS bx FROM a) SELECT lvl, cast(by_ AS int) AS by_, cast(bx AS int) AS bx, cast(bx * (256 << lvl) AS int) AS x0, cast(by_ * (256 << lvl) AS int) AS y0, cast((bx + 1) * (256 << lvl) AS int) AS x1, cast((by_ + 1) * (256 << lvl) AS int) AS y1 FROM b")
def block_grid(spark, d):
    return points.block_grid(1000, 700, 256, 4, spark).withColumnRenamed("by", "by_")


_WIN = "o AS (SELECT cast(a.r AS int) AS oy, cast(b.r AS int) AS ox FROM range(32) a(r), range(32) b(r))"


@query(f"{MAP}, {_WIN} SELECT oy, ox, coalesce(v, 0::double) AS v FROM o LEFT JOIN img ON img.x = cast(floor(40 + (ox + 0.5) * 1.5) AS int) AND img.y = cast(floor(-8 + (oy + 0.5) * 1.5) AS int)")
def raster_window(spark, d):
    return points.raster_window(img(spark, d), 40, -8, 88, 40, 32, 32)


@query(f"{MAP}, {_WIN}, f AS (SELECT oy, ox, 8 + (ox + 0.5) * 0.75 - 0.5 AS fx, 4 + (oy + 0.5) * 0.75 - 0.5 AS fy FROM o), t AS (SELECT oy, ox, floor(fx) + i.r AS sx, floor(fy) + j.r AS sy, CASE WHEN i.r = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j.r = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w FROM f, range(2) i(r), range(2) j(r)) SELECT oy, ox, round(sum(cast(t.w AS double) * coalesce(v, 0::double)), 6) AS v FROM t LEFT JOIN img ON img.x = t.sx AND img.y = t.sy GROUP BY oy, ox")
def raster_bilinear(spark, d):
    return points.raster_window(img(spark, d), 8, 4, 32, 28, 32, 32, bilinear=True).select("oy", "ox", *r6("v"))


@query(f"{MAP} SELECT y, x, v FROM img WHERE y >= 16 AND y < 32 AND x >= 32 AND x < 48")
def raster_block(spark, d):
    return points.raster_block(img(spark, d), 1, 2, 16)


_INV = [0.5, 0, 0, 0.125, 0, 0.5, 0, -0.25, 0, 0, 0, -1.0, 0, 0, -0.5, 1.0]


@query(f"{MAP} SELECT y, x, round((x / 64::double * 0.5 + 0.125) / (v * -0.5 + 1), 6) AS px, round((y / 64::double * 0.5 - 0.25) / (v * -0.5 + 1), 6) AS py, round(1 / (v * -0.5 + 1), 6) AS pz FROM img")
def unproject(spark, d):
    i = img(spark, d).select("y", "x", (F.col("x") / 64.0).alias("u"), (F.col("y") / 64.0).alias("v_"), F.col("v").alias("z")).withColumnRenamed("v_", "v")
    return points.unproject(i, _INV).select("y", "x", *r6("px", "py", "pz"))


@query(f"{MAP} SELECT y, x, CASE WHEN x < 4 OR y < 4 OR x >= 60 OR y >= 60 THEN 0::double ELSE 1 - v END AS v FROM img")
def elevation(spark, d):
    return points.elevation(img(spark, d), G, G)


@query("n AS (SELECT a.r AS s, b.r AS i, c.r AS j FROM range(17) a(r), range(20) b(r), range(20) c(r)) SELECT cast(s AS int) AS s, cast(i AS int) AS i, cast(j AS int) AS j, round(0.5 + s / 34::double * sin(i * (pi() / 20)) * cos(j * (2 * pi() / 20)), 6) AS x, round(0.5 + s / 34::double * sin(i * (pi() / 20)) * sin(j * (2 * pi() / 20)), 6) AS y, round(0.5 + s / 34::double * cos(i * (pi() / 20)), 6) AS z, CASE WHEN s BETWEEN 6 AND 9 THEN 1::double ELSE 0::double END AS val FROM n")
def nested_spheres(spark, d):
    return points.nested_spheres(spark, 17, 20, 20).select("s", "i", "j", *r6("x", "y", "z"), "val")


@query("g AS (SELECT a.r / 64::double AS y, b.r / 64::double AS x FROM range(64) a(r), range(64) b(r)) SELECT x, y, CASE WHEN x + y > 0.75 AND x - y < 0.25 AND y < 0.75 THEN 0.5::double WHEN x > 0.75 AND y > 0.5 THEN 0.25::double ELSE 0::double END AS z FROM g")
def plateau_terrain(spark, d):
    return points.plateau(spark, 64)


# --- voxels and octrees -------------------------------------------------------------------------------------------------------------


@query(f"{VOX} SELECT x, y, z, n FROM vox")
def voxel_count_l5(spark, d):
    return vox(spark, d).select("x", "y", "z", "n")


@query(f"{VOX}, k AS (SELECT x, y, z, (5::bigint << 59) | (z::bigint << 38) | (y::bigint << 19) | x::bigint AS k FROM vox) SELECT k, cast(k >> 59 AS int) AS d, x, y, z FROM k")
def voxel_key_roundtrip(spark, d):
    k = vox(spark, d).select(S.voxel_key(F.lit(LEVEL), "x", "y", "z").alias("k"))
    return k.select("k", *[S.voxel_part(F.col("k"), p).alias(p) for p in "dxyz"])


_GOOD = f"{VOX}, off AS (SELECT a.r - 1 AS dx, b.r - 1 AS dy FROM range(3) a(r), range(3) b(r)), near AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z FROM vox, off WHERE n >= 6), kept AS (SELECT p.x, p.y, p.z FROM pts p WHERE EXISTS (SELECT 1 FROM near WHERE near.x = cast(floor(p.x * {SIZE}) AS int) AND near.y = cast(floor(p.y * {SIZE}) AS int) AND near.z = cast(floor(p.z * {SIZE}) AS int)))"


@query(f"{_GOOD} SELECT * FROM kept")
def outlier_filter_l5(spark, d):
    return voxels.filter_outliers(pts(spark, d), LEVEL)


@query(f"{MAP} SELECT y, x, v, w FROM img")
def heightmap_max(spark, d):
    return img(spark, d)


@query(f"{_GOOD}, {GRID}, top AS (SELECT cast(least(floor(y * {G} + 0.5), {G - 1}) AS int) AS y, cast(least(floor(x * {G} + 0.5), {G - 1}) AS int) AS x, max(z) AS v FROM kept GROUP BY 1, 2) SELECT grid.y, grid.x, coalesce(v, 0::double) AS v, CASE WHEN v IS NULL THEN 0::double ELSE 1::double END AS w FROM grid LEFT JOIN top USING (y, x)")
def heightmap_filtered(spark, d):
    return filtered_heightmap(spark, d, LEVEL)


def filtered_heightmap(spark, d, level: int) -> DataFrame:
    return voxels.heightmap(voxels.filter_outliers(pts(spark, d), level), G)


_TREE = f"{PTS}, l AS (SELECT cast(r AS int) AS lvl FROM range(2, 7) t(r)), tree AS (SELECT lvl, cast(floor(x * (1 << lvl)) AS int) AS x, cast(floor(y * (1 << lvl)) AS int) AS y, cast(floor(z * (1 << lvl)) AS int) AS z, count(*) AS n FROM pts, l WHERE z < 1 GROUP BY 1, 2, 3, 4)"


@query(f"{_TREE} SELECT * FROM tree")
def octree_levels(spark, d):
    return voxels.octree(pts(spark, d), 6, 2).select("lvl", "x", "y", "z", "n")


@query(f"{_TREE}, c AS (SELECT lvl, count(*) AS n FROM tree GROUP BY lvl) SELECT lvl, n, cast(coalesce(sum(n) OVER (ORDER BY lvl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start, round(n / cast(lag(n) OVER (ORDER BY lvl DESC) AS double), 6) AS retain FROM c")
def octree_retain(spark, d):
    return voxels.level_stats(voxels.octree(pts(spark, d), 6, 2)).select("lvl", "n", "start", *r6("retain"))


@query(f"{_TREE} SELECT x, y, z, n, (x + 0.0::double) / 16 AS px, (y + 0.0::double) / 16 AS py, (z + 0.0::double) / 16 AS pz FROM tree WHERE lvl = 4")
def level_extract(spark, d):
    """One level of a tree, by its filter, with positions."""
    t = voxels.octree(pts(spark, d), 6, 2).where("lvl = 4")
    return voxels.node_centres(t).select("x", "y", "z", "n", "px", "py", "pz")


@query(f"{VOX}, " + ", ".join(f"a{i} AS (SELECT x >> {i} AS x, y >> {i} AS y, z >> {i} AS z, sum(n) AS n FROM vox GROUP BY 1, 2, 3)" for i in range(1, 6)) + " SELECT v.x, v.y, v.z, v.n, v.n + " + " + ".join(f"a{i}.n * {0.5**i}::double" for i in range(1, 6)) + " AS density FROM vox v " + " ".join(f"JOIN a{i} ON a{i}.x = v.x >> {i} AND a{i}.y = v.y >> {i} AND a{i}.z = v.z >> {i}" for i in range(1, 6)))
def density_pyramid(spark, d):
    return voxels.density(pts(spark, d), LEVEL)


@query(f"{VOX}, a AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, sum(n) AS n FROM vox GROUP BY 1, 2, 3), d AS (SELECT v.x, v.y, v.z, v.n + a.n * 0.5::double AS density FROM vox v JOIN a ON a.x = v.x >> 1 AND a.y = v.y >> 1 AND a.z = v.z >> 1) SELECT * FROM d WHERE density > 2")
def density_threshold(spark, d):
    return voxels.density(pts(spark, d), LEVEL, 2).drop("n").where("density > 2")


_OFF = lambda r: f"off AS (SELECT cast(a.r - {r} AS int) AS dx, cast(b.r - {r} AS int) AS dy, cast(c.r - {r} AS int) AS dz FROM range({2 * r + 1}) a(r), range({2 * r + 1}) b(r), range({2 * r + 1}) c(r))"


@query(f"{VOX}, {_OFF(1)} SELECT v.x, v.y, v.z, count(*) AS k, cast(sum(u.n) AS bigint) AS total FROM (SELECT * FROM vox CROSS JOIN off) v JOIN vox u ON u.x = v.x + dx AND u.y = v.y + dy AND u.z = v.z + dz GROUP BY 1, 2, 3")
def neighbors27(spark, d):
    n = voxels.neighbour_sums(vox(spark, d))
    return n.select("x", "y", "z", "k", F.col("total").cast("long").alias("total"))


_TWO = f"{VOX}, fine AS (SELECT x, y, z FROM vox WHERE n >= 4), coarse AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, cast(sum(n) AS double) AS val FROM vox GROUP BY 1, 2, 3)"


def _two(spark, d):
    v = vox(spark, d)
    return v.where("n >= 4"), voxels.coarser(v)


@query(f"{_TWO} SELECT x, y, z, val FROM coarse c WHERE EXISTS (SELECT 1 FROM fine f WHERE f.x >> 1 = c.x AND f.y >> 1 = c.y AND f.z >> 1 = c.z)")
def children_exist(spark, d):
    fine, coarse = _two(spark, d)
    return voxels.with_children(coarse, fine).select("x", "y", "z", "val")


@query(f"{_TWO} SELECT 5 AS lvl, x, y, z, cast(n AS double) AS val FROM vox WHERE n >= 4 UNION ALL SELECT 4, x, y, z, val FROM coarse c WHERE NOT EXISTS (SELECT 1 FROM fine f WHERE f.x >> 1 = c.x AND f.y >> 1 = c.y AND f.z >> 1 = c.z)")
def compress_leaves(spark, d):
    fine, coarse = _two(spark, d)
    return voxels.compress({LEVEL: fine, LEVEL - 1: coarse})


@query(f"{_TWO}, p AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, (x & 1) * 2 - 1 AS sx, (y & 1) * 2 - 1 AS sy, (z & 1) * 2 - 1 AS sz FROM fine), big AS (SELECT x, y, z, val FROM coarse WHERE val >= 30), c AS (SELECT x + sx AS x, y, z FROM p UNION SELECT x, y + sy, z FROM p UNION SELECT x, y, z + sz FROM p UNION SELECT x + sx, y + sy, z + sz FROM p WHERE sx = sy AND sy = sz), m AS (SELECT * FROM c WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 AND z BETWEEN 0 AND 15 AND NOT EXISTS (SELECT 1 FROM big b WHERE b.x = c.x AND b.y = c.y AND b.z = c.z)) SELECT x, y, z, val FROM big UNION ALL SELECT x, y, z, 1e-9::double FROM m")
def balance_step(spark, d):
    fine, coarse = _two(spark, d)
    big = coarse.where("val >= 30")
    return voxels.sparse_add(big, voxels.missing_neighbours(big, fine, SIZE // 2))


@query(f"{_TWO}, e AS (SELECT a.r AS i, b.r AS j, c.r AS k FROM range(2) a(r), range(2) b(r), range(2) c(r)), s AS (SELECT DISTINCT cast((x >> 1) * 2 + i AS int) AS x, cast((y >> 1) * 2 + j AS int) AS y, cast((z >> 1) * 2 + k AS int) AS z FROM fine, e) SELECT s.x, s.y, s.z, coalesce(cast(v.n AS double), 1e-9::double) AS val FROM s LEFT JOIN (SELECT * FROM vox WHERE n >= 4) v USING (x, y, z)")
def complete_parents(spark, d):
    fine, _ = _two(spark, d)
    return voxels.sparse_add(fine, voxels.missing_siblings(fine))


@query(f"{VOX} SELECT x, y, z, (x + 0.5) / 32::double AS px, (y + 0.5) / 32::double AS py, (z + 0.5) / 32::double AS pz FROM vox")
def node_centers(spark, d):
    return voxels.node_centres(vox(spark, d).withColumn("lvl", F.lit(LEVEL)), compressed=True).select("x", "y", "z", "px", "py", "pz")


def _cov(src: str, name: str, r: int = 2) -> str:
    return f"{name} AS (SELECT v.x, v.y, v.z, " + ", ".join(f"sum(u.n * {a} * {b} / cast(greatest(dx * dx + dy * dy + dz * dz, 1) AS double)) AS {k}" for k, a, b in voxels._SIX) + f", sum(u.n) AS support FROM (SELECT * FROM {src} CROSS JOIN off) v JOIN {src} u ON u.x = v.x + dx AND u.y = v.y + dy AND u.z = v.z + dz GROUP BY 1, 2, 3)"


_SIX6 = ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k, _, _ in voxels._SIX)


def _r0(*cols):
    return [(F.round(c, 6) + 0.0).alias(c) for c in cols]


@query(f"{VOX}, {_OFF(2)}, {_cov('vox', 'c')} SELECT x, y, z, {_SIX6}, cast(support AS double) AS support FROM c")
def cov_sums(spark, d):
    return voxels.covariances(vox(spark, d)).select("x", "y", "z", *_r0("xx", "yy", "zz", "xy", "xz", "yz"), "support")


@query(f"{VOX}, b0 AS (SELECT x, y, z, n FROM vox), b1 AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, sum(n) AS n FROM b0 GROUP BY 1, 2, 3), {_OFF(2)}, {_cov('b0', 'c0')}, {_cov('b1', 'c1')} SELECT b.x, b.y, b.z, " + ", ".join(f"round(CASE WHEN c0.support > 4 THEN c0.{k} ELSE 0 END + CASE WHEN c1.support > 4 THEN c1.{k} * 0.25 ELSE 0 END, 6) + 0.0 AS {k}" for k, _, _ in voxels._SIX) + ", cast(c0.support + c1.support AS double) AS support FROM b0 b JOIN c0 ON c0.x = b.x AND c0.y = b.y AND c0.z = b.z JOIN c1 ON c1.x = b.x >> 1 AND c1.y = b.y >> 1 AND c1.z = b.z >> 1")
def cov_multilevel(spark, d):
    return voxels.covariances_multilevel(vox(spark, d), 2).select("x", "y", "z", *_r0("xx", "yy", "zz", "xy", "xz", "yz"), "support")


@query(f"{VOX}, c AS (SELECT v.x, v.y, v.z, sum(u.n) AS support FROM vox v JOIN vox u ON u.x BETWEEN v.x - 2 AND v.x + 2 AND u.y BETWEEN v.y - 2 AND v.y + 2 AND u.z = v.z GROUP BY 1, 2, 3) SELECT x, y, z, CASE WHEN support > 40 THEN cast(support AS double) END AS support FROM c")
def support_filter(spark, d):
    return voxels.layer_support(vox(spark, d))


@query()
def normals(spark, d):
    n = voxels.normals(voxels.covariances_multilevel(vox(spark, d), 2))
    return n.select("x", "y", "z", *[F.round(F.element_at("normal", k + 1), 6).alias(f"n{a}") for k, a in enumerate("xyz")])


#: moments of two levels as ``cov_multilevel`` has them, and the eigenvalues of a symmetric matrix by its characteristic cubic
_EIGEN = f"{VOX}, b1 AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, sum(n) AS n FROM vox GROUP BY 1, 2, 3), {_OFF(2)}, {_cov('vox', 'c0')}, {_cov('b1', 'c1')}, m AS (SELECT c0.x, c0.y, c0.z, c0.support + c1.support AS support, " + ", ".join(f"CASE WHEN c0.support > 4 THEN c0.{k} ELSE 0 END + CASE WHEN c1.support > 4 THEN c1.{k} * 0.25 ELSE 0 END AS {k}" for k, _, _ in voxels._SIX) + " FROM c0 JOIN c1 ON c1.x = c0.x >> 1 AND c1.y = c0.y >> 1 AND c1.z = c0.z >> 1), q AS (SELECT *, (xx + yy + zz) / 3 AS mid FROM m), s AS (SELECT *, sqrt(((xx - mid) ** 2 + (yy - mid) ** 2 + (zz - mid) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), t AS (SELECT *, CASE WHEN p > 0 THEN acos(least(greatest((((xx - mid) * ((yy - mid) * (zz - mid) - yz * yz) - xy * (xy * (zz - mid) - yz * xz) + xz * (xy * yz - (yy - mid) * xz)) / (p * p * p)) / 2, -1), 1)) / 3 END AS phi FROM s), e AS (SELECT *, mid + 2 * p * cos(phi) AS high, mid + 2 * p * cos(phi + 2 * pi() / 3) AS low FROM t)"


@query(f"{_EIGEN} SELECT x, y, z, support > 4 AND p > 0 AND coalesce(3 * mid - high - 2 * low > 1e-6 * greatest(high, 1e-30), FALSE) AS determined, TRUE AS proper FROM e")
def normals_proven(spark, d):
    """L1, L2: which cells have a normal, and that it is one: of length 1, its largest component positive, and an eigenvector of the moments (residual by the least eigenvalue, as Rayleigh's quotient has it)."""
    moments = settle(voxels.covariances_multilevel(vox(spark, d), 2))
    n = voxels.normals(moments).select("x", "y", "z", "normal").join(moments, ["x", "y", "z"])
    v = [F.element_at("normal", k + 1) for k in range(3)]
    rows = [("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz")]
    image = [sum((F.col(c) * x for c, x in zip(r[1:], v[1:], strict=True)), F.col(r[0]) * v[0]) for r in rows]
    least = sum((a * b for a, b in zip(image[1:], v[1:], strict=True)), image[0] * v[0])
    scale = F.col("xx") + F.col("yy") + F.col("zz")
    apart = F.greatest(*[F.abs(a - least * b) for a, b in zip(image, v, strict=True)]) <= 1e-9 * scale
    unit = F.abs(sum((x * x for x in v[1:]), v[0] * v[0]) - 1) <= 1e-9
    lead = F.greatest(*v) >= F.greatest(*[-x for x in v]) - 1e-9
    lowest = least <= scale / 3 + 1e-9 * scale
    return n.select("x", "y", "z", F.col("normal").isNotNull().alias("determined"), F.coalesce(apart & unit & lead & lowest, F.lit(True)).alias("proper"))


@query()
def normals_multilevel(spark, d):
    return voxels.normals_multilevel(vox(spark, d), 2)


_VIS = lambda src, name: f"{name} AS (SELECT v.x, v.y, v.z, 255 - coalesce(sum(DISTINCT (1 << cast(r.i AS int))), 0) AS mask FROM {src} v LEFT JOIN (SELECT v2.x, v2.y, v2.z, v2.i FROM (SELECT x, y, z, i, x + dx * p AS ux, y + dy * p AS uy, z + p * 5 + h AS uz FROM {src} CROSS JOIN r CROSS JOIN range(5) t(h)) v2 JOIN {src} u ON u.x = ux AND u.y = uy AND u.z = uz WHERE uz > v2.z) r ON r.x = v.x AND r.y = v.y AND r.z = v.z GROUP BY 1, 2, 3)"
_RAYS = "r AS (SELECT i, dx, dy, p.r AS p FROM (VALUES (0, 0, 0), (1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)) t(i, dx, dy), range(20) p(r))"


@query(f"{VOX}, {_RAYS}, {_VIS('vox', 'm')} SELECT x, y, z, cast(mask AS int) AS mask FROM m")
def visibility_mask(spark, d):
    return voxels.visibility(vox(spark, d))


@query(f"{VOX}, {_RAYS}, up AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z FROM vox GROUP BY 1, 2, 3), {_VIS('vox', 'm0')}, {_VIS('up', 'm1')} SELECT m0.x, m0.y, m0.z, cast(m0.mask & m1.mask AS int) AS mask, (m0.mask & m1.mask) = 255 AS open FROM m0 JOIN m1 ON m1.x = m0.x >> 1 AND m1.y = m0.y >> 1 AND m1.z = m0.z >> 1")
def visibility_combine(spark, d):
    v = settle(vox(spark, d))
    m = voxels.combine_visibility({0: voxels.visibility(v), 1: voxels.visibility(voxels.coarser(v))})
    return m.withColumn("open", F.col("mask") == 255)


# --- images -------------------------------------------------------------------------------------------------------------------------

_TAPS9 = "t AS (SELECT i.y + a.r - 1 AS y, i.x + b.r - 1 AS x, 1 - a.r AS dy, 1 - b.r AS dx, v FROM img i, range(3) a(r), range(3) b(r))"


@query(f"{MAP}, {_TAPS9}, g AS (SELECT y, x, sum(-dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * v) / 4 AS gx, sum(-dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) * v) / 4 AS gy FROM t GROUP BY y, x) SELECT i.y, i.x, CASE WHEN i.y = 0 OR i.x = 0 THEN 0::double ELSE round(sqrt(gx * gx + gy * gy), 6) END AS v FROM img i JOIN g ON g.y = i.y AND g.x = i.x")
def sobel_mag(spark, d):
    return images.sobel(img(spark, d)).select("y", "x", *r6("v"))


@query(f"{MAP} SELECT a.y, a.x, quantile_cont(b.v, 0.5) AS v FROM img a JOIN img b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.y, a.x")
def median5(spark, d):
    return images.median(img(spark, d), 5)


def _k(d: str) -> str:
    return f"(CASE WHEN {d} IN (0, 1) THEN 3 ELSE 1 END)"


def _down(src: str, dst: str, size: int) -> str:
    t = f"{dst}_s AS (SELECT a.r AS y, b.r AS x, sum(i.v * {_k('i.y - 2 * a.r')} * {_k('i.x - 2 * b.r')} / 64::double) AS a, sum(i.w * {_k('i.y - 2 * a.r')} * {_k('i.x - 2 * b.r')} / 64::double) AS b FROM range({size}) a(r), range({size}) b(r) JOIN {src} i ON i.y BETWEEN 2 * a.r - 1 AND 2 * a.r + 2 AND i.x BETWEEN 2 * b.r - 1 AND 2 * b.r + 2 GROUP BY 1, 2)"
    return t + f", {dst} AS (SELECT y, x, a / least(greatest(b, 1e-7), 999) * (1 - pow(1 - least(greatest(b, 1e-7), 1), 16)) AS v, 1 - pow(1 - least(greatest(b, 1e-7), 1), 16) AS w FROM {dst}_s)"


def _up(fine: str, coarse: str, dst: str) -> str:
    return f"{dst}_s AS (SELECT f.y, f.x, sum(c.v * {_k('c.y - f.y // 2')} * {_k('c.x - f.x // 2')} / 64::double) AS b FROM {fine} f JOIN {coarse} c ON c.y BETWEEN f.y // 2 - 1 AND f.y // 2 + 2 AND c.x BETWEEN f.x // 2 - 1 AND f.x // 2 + 2 GROUP BY 1, 2), {dst} AS (SELECT f.y, f.x, (1 - f.w) * coalesce(b, 0) + f.w * f.v AS v FROM {fine} f LEFT JOIN {dst}_s s ON s.y = f.y AND s.x = f.x)"


@query(f"{MAP}, {_down('img', 'l1', 32)} SELECT cast(y AS int) AS y, cast(x AS int) AS x, round(v, 6) AS v, round(w, 6) AS w FROM l1")
def push_level(spark, d):
    return images.push(img(spark, d)).select("y", "x", *r6("v", "w"))


@query(f"{MAP}, {_down('img', 'l1', 32)}, {_up('img', 'l1', 'u0')} SELECT cast(y AS int) AS y, cast(x AS int) AS x, round(v, 6) AS v FROM u0")
def pull_level(spark, d):
    i = img(spark, d)
    return images.pull(i, images.push(i)).select("y", "x", *r6("v"))


@query(f"{MAP}, {_down('img', 'l1', 32)}, {_down('l1', 'l2', 16)}, {_down('l2', 'l3', 8)}, {_down('l3', 'l4', 4)}, {_up('l3', 'l4', 'u3')}, {_up('l2', 'u3', 'u2')}, {_up('l1', 'u2', 'u1')}, {_up('img', 'u1', 'u0')} SELECT cast(y AS int) AS y, cast(x AS int) AS x, round(v, 6) AS v FROM u0")
def push_pull(spark, d):
    return images.push_pull(img(spark, d), 4).select("y", "x", *r6("v"))


@query(f"{MAP}, p AS (SELECT y, x, x / 64::double AS px, y / 64::double AS py, 1 - v AS z FROM img), r AS (SELECT *, row_number() OVER (PARTITION BY y // 2, x // 2 ORDER BY z, -(y % 2 * 2 + x % 2)) AS k FROM p) SELECT cast(y // 2 AS int) AS y, cast(x // 2 AS int) AS x, px, py, z FROM r WHERE k = 1")
def min_pyramid(spark, d):
    return images.min_pyramid(_xyz(img(spark, d)))


def _xyz(i: DataFrame) -> DataFrame:
    return i.select("y", "x", (F.col("x") / 64.0).alias("px"), (F.col("y") / 64.0).alias("py"), (1.0 - F.col("v")).alias("z"))


def _walk(dy: int, dx: int) -> str:
    return f"(CASE WHEN EXISTS (SELECT 1 FROM dep q, range(1, 8) s(r) WHERE q.y = p.y + {dy} * s.r AND q.x = p.x + {dx} * s.r AND q.v <= 0.99999 AND q.v >= 0.00001 AND p.v - q.v > s.r * 0.001) THEN 1 ELSE 0 END)"


@query(f"{MAP}, dep AS (SELECT y, x, 1 - v AS v FROM img), b AS (SELECT y, x, v, {_walk(0, 1)} + {_walk(0, -1)} + {_walk(1, 0)} + {_walk(-1, 0)} AS n FROM dep p) SELECT y, x, cast(CASE WHEN v > 0.9999999 THEN 0 ELSE n END AS int) AS blocked, v <= 0.9999999 AND n >= 3 AS masked FROM b")
def occlusion_walk(spark, d):
    return images.occlusion_walk(img(spark, d).select("y", "x", (1.0 - F.col("v")).alias("v")))


_RING = "ring AS (SELECT cast(a.r - 1 AS int) AS j, cast(b.r - 1 AS int) AS i, a.r * 3 + b.r AS k FROM range(3) a(r), range(3) b(r) WHERE NOT (a.r = 1 AND b.r = 1))"


@query(f"{MAP}, {_RING}, p AS (SELECT y, x, x / 64::double AS px, y / 64::double AS py, 1 - v + 0.125 AS z FROM img), m AS (SELECT y // 2 AS y, x // 2 AS x, arg_min(struct_pack(px := px, py := py, z := z), struct_pack(z := z, o := -(y % 2 * 2 + x % 2))) AS s FROM p GROUP BY 1, 2), lv AS (SELECT 0 AS l, y, x, px, py, z FROM p UNION ALL SELECT 1, y, x, s.px, s.py, s.z FROM m), src AS (SELECT *, least(greatest(floor(log2(16 / z)), 0), 1) AS most FROM p), o AS (SELECT s.y, s.x, ring.k, 1 + ((q.px - s.px) * q.px + (q.py - s.py) * q.py + (q.z - s.z) * q.z) / nullif(sqrt((q.px - s.px) * (q.px - s.px) + (q.py - s.py) * (q.py - s.py) + (q.z - s.z) * (q.z - s.z)) * sqrt(q.px * q.px + q.py * q.py + q.z * q.z), 0) AS occ FROM src s, ring JOIN lv q ON q.l <= s.most AND q.y = (s.y >> q.l) + j AND q.x = (s.x >> q.l) + i), sec AS (SELECT y, x, k, min(occ) AS occ FROM o WHERE occ IS NOT NULL GROUP BY 1, 2, 3) SELECT y, x, round(avg(occ), 6) AS open, avg(occ) < 0.12 AS masked FROM sec GROUP BY y, x")
def sector_occlusion(spark, d):
    base = _xyz(img(spark, d)).withColumn("z", F.col("z") + 0.125)
    return images.sector_occlusion({0: base, 1: images.min_pyramid(base)}).select("y", "x", *r6("open"), "masked")


@query(f"{MAP} SELECT y, x, v, lead(v) OVER (PARTITION BY y ORDER BY x) AS xp, lag(v) OVER (PARTITION BY y ORDER BY x) AS xm, lead(v) OVER (PARTITION BY x ORDER BY y) AS yp, lag(v) OVER (PARTITION BY x ORDER BY y) AS ym FROM img")
def height_steps(spark, d):
    return images.height_steps(img(spark, d))


@query(f"{MAP}, q AS (SELECT a.r AS qy, b.r AS qx, y, x, v FROM range(4) a(r), range(4) b(r) JOIN img ON y - a.r * 16 BETWEEN 0 AND 23 AND x - b.r * 16 BETWEEN 0 AND 23) SELECT cast(qy AS int) AS qy, cast(qx AS int) AS qx, cast(y - qy * 16 + 12 AS int) AS py, cast(x - qx * 16 + 12 AS int) AS px, round(v * least(1, least(x, 64 - x) / 8::double) * least(1, least(y, 64 - y) / 8::double) * pow(sin(pi() * (x - qx * 16) / 24::double), 2) * pow(sin(pi() * (y - qy * 16) / 24::double), 2), 6) AS v FROM q")
def patch_window(spark, d):
    return images.patch_window(img(spark, d), G, G, 16, 4, 8).select("qy", "qx", "py", "px", *r6("v"))


@query(f"{MAP} SELECT cast((y + 32) % 64 AS int) AS y, cast((x + 32) % 64 AS int) AS x, v FROM img")
def fft_shift(spark, d):
    return images.fft_shift(img(spark, d), G, G)


@query(f"{MAP}, r AS (SELECT y // 16 AS q, y % 16 AS yy, x, v, row_number() OVER (PARTITION BY y // 16 ORDER BY v DESC, y, x) AS k FROM img) SELECT cast(q AS int) AS q, cast(x - 32 AS int) AS dx, cast(yy - 8 AS int) AS dy, v AS peak FROM r WHERE k = 1")
def peak_per_patch(spark, d):
    i = img(spark, d).select(F.expr("y div 16").cast("int").alias("q"), (F.col("y") % 16).alias("y"), "x", "v")
    return images.peaks(i, ["q"], G, 16)


@query()
def align_offsets(spark, d):
    i = img(spark, d).select("y", "x", "v")
    moved = i.select("y", (F.col("x") - 3).alias("x"), "v").where("x >= 0")
    return images.align(i, moved, G, G, 32, 8)


#: the map, and another image: the map moved by (3, 1), mixed with the lowest heights
_PAIR = f"{MAP}, low AS (SELECT cast(least(greatest(floor(y * {G} + 0.5), 0), {G - 1}) AS int) AS y, cast(least(greatest(floor(x * {G} + 0.5), 0), {G - 1}) AS int) AS x, min(z) AS v FROM pts GROUP BY 1, 2), img2 AS (SELECT i.y, i.x, coalesce(m.v, 0::double) * 0.75::double + coalesce(low.v, 0::double) * 0.25::double AS v FROM img i LEFT JOIN img m ON m.y = i.y - 1 AND m.x = i.x - 3 LEFT JOIN low ON low.y = i.y AND low.x = i.x)"


def _edges_of(src: str, name: str) -> str:
    """Sobel magnitudes of an image, and its patches of 48 pixels (32 and an overlap of 8) under their windows."""
    return (
        f"{name}_t AS (SELECT i.y + a.r - 1 AS y, i.x + b.r - 1 AS x, 1 - a.r AS dy, 1 - b.r AS dx, v FROM {src} i, range(3) a(r), range(3) b(r)), "
        f"{name}_g AS (SELECT y, x, sum(-dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * v) / 4 AS gx, sum(-dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) * v) / 4 AS gy FROM {name}_t GROUP BY y, x), "
        f"{name}_s AS (SELECT y, x, CASE WHEN y = 0 OR x = 0 THEN 0::double ELSE sqrt(gx * gx + gy * gy) END AS v FROM {name}_g WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63), "
        f"{name} AS MATERIALIZED (SELECT a.r AS qy, b.r AS qx, y - a.r * 32 AS ly, x - b.r * 32 AS lx, v * least(1, least(x, 64 - x) / 32::double) * least(1, least(y, 64 - y) / 32::double) * pow(sin(pi() * (x - b.r * 32) / 48::double), 2) * pow(sin(pi() * (y - a.r * 32) / 48::double), 2) AS v FROM range(2) a(r), range(2) b(r) JOIN {name}_s ON y - a.r * 32 BETWEEN 0 AND 47 AND x - b.r * 32 BETWEEN 0 AND 47)"
    )


@query(f"{_PAIR}, {_edges_of('img', 'pa')}, {_edges_of('img2', 'pb')}, corr AS (SELECT pa.qy, pa.qx, pa.ly - pb.ly AS dy, pa.lx - pb.lx AS dx, sum(pa.v * pb.v) AS c FROM pa JOIN pb ON pb.qy = pa.qy AND pb.qx = pa.qx GROUP BY 1, 2, 3, 4), best AS (SELECT *, row_number() OVER (PARTITION BY qy, qx ORDER BY c DESC) AS k FROM corr) SELECT cast(qy AS int) AS qy, cast(qx AS int) AS qx, cast(dx AS int) AS dx, cast(dy AS int) AS dy, round(c, 6) AS peak FROM best WHERE k = 1")
def align_images(spark, d):
    """The offset of each patch of one image against another one, by direct sums over all pairs of pixels in SQL."""
    first = settle(img(spark, d).select("y", "x", "v"))
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * float(G) + 0.5), F.lit(0)), F.lit(G - 1)).cast("int")
    low = pts(spark, d).groupBy(at("y").alias("y"), at("x").alias("x")).agg(F.min("z").alias("low"))
    moved = first.select((F.col("y") + 1).alias("y"), (F.col("x") + 3).alias("x"), F.col("v").alias("m"))
    both = first.select("y", "x").join(moved, ["y", "x"], "left").join(low, ["y", "x"], "left")
    second = settle(both.select("y", "x", (F.coalesce("m", F.lit(0.0)) * 0.75 + F.coalesce("low", F.lit(0.0)) * 0.25).alias("v")))
    return images.align(first, second, G, G, 32, 8).select("qy", "qx", "dx", "dy", *r6("peak"))


# --- surfaces -----------------------------------------------------------------------------------------------------------------------

_S = 16
_HILL = f"{PTS}, g16 AS (SELECT cast(a.r AS int) AS y, cast(b.r AS int) AS x FROM range({_S}) a(r), range({_S}) b(r)), t16 AS (SELECT cast(least(floor(y * {_S} + 0.5), {_S - 1}) AS int) AS y, cast(least(floor(x * {_S} + 0.5), {_S - 1}) AS int) AS x, min(z) AS v FROM pts GROUP BY 1, 2), hill AS (SELECT g16.y, g16.x, coalesce(v, 0::double) * 8 AS v FROM g16 LEFT JOIN t16 USING (y, x))"
_NODES = f"{_HILL}, st AS (SELECT y, x, v, lead(v) OVER (PARTITION BY y ORDER BY x) AS xp, lag(v) OVER (PARTITION BY y ORDER BY x) AS xm, lead(v) OVER (PARTITION BY x ORDER BY y) AS yp, lag(v) OVER (PARTITION BY x ORDER BY y) AS ym FROM hill), lv AS (SELECT cast(unnest(range(cast(floor(least(0, min(v) * {_S})) AS bigint), cast(floor(max(v) * {_S} + 1) AS bigint))) AS int) AS z FROM hill), nd AS (SELECT x, y, z, (CASE WHEN z / {_S}::double > v THEN 1 ELSE 0 END) + " + " + ".join(f"(CASE WHEN z / {_S}::double > {c} AND {c} < (z - 1) / {_S}::double THEN {b} ELSE 0 END)" for c, b in (("xp", 4), ("xm", 8), ("yp", 16), ("ym", 32))) + f" AS mask FROM st, lv WHERE (z - 1) / {_S}::double <= v), nodes AS (SELECT * FROM nd WHERE mask <> 0)"
_CORNERS = "corner(k, j, ox, oy, oz) AS (VALUES " + ", ".join(map(str, surfaces.face_corners())) + ")"
_MESH = f"{_NODES}, {_CORNERS}, face AS (SELECT x, y, z, cast(k.r AS int) AS k FROM nodes, range(6) k(r) WHERE (mask >> cast(k.r AS int)) & 1 = 1), quad AS (SELECT f.x, f.y, f.z, f.k, j, f.x + ox AS vx, f.y + oy AS vy, f.z + oz AS vz FROM face f JOIN corner USING (k)), vert AS (SELECT row_number() OVER (ORDER BY vz, vy, vx) - 1 AS vid, vx, vy, vz, vx / {_S}::double AS x, vy / {_S}::double AS y, vz / {_S}::double AS z FROM (SELECT DISTINCT vx, vy, vz FROM quad)), qv AS (SELECT q.x, q.y, q.z, q.k, max(vid) FILTER (j = 0) AS v0, max(vid) FILTER (j = 1) AS v1, max(vid) FILTER (j = 2) AS v2, max(vid) FILTER (j = 3) AS v3 FROM quad q JOIN vert USING (vx, vy, vz) GROUP BY 1, 2, 3, 4), tr AS (SELECT x, y, z, k, 0 AS t, CASE WHEN k IN (1, 3, 4) THEN v1 ELSE v0 END AS a, CASE WHEN k IN (1, 3, 4) THEN v0 ELSE v1 END AS b, v2 AS c FROM qv UNION ALL SELECT x, y, z, k, 1, CASE WHEN k IN (1, 3, 4) THEN v3 ELSE v2 END, CASE WHEN k IN (1, 3, 4) THEN v2 ELSE v3 END, v0 FROM qv), tri AS (SELECT row_number() OVER (ORDER BY z, y, x, k, t) - 1 AS tid, * FROM tr)"


def _hill(spark, d) -> DataFrame:
    at = lambda c: F.least(F.floor(F.col(c) * float(_S) + 0.5), F.lit(_S - 1)).cast("int")
    low = pts(spark, d).groupBy(at("y").alias("y"), at("x").alias("x")).agg(F.min("z").alias("v"))
    return points.grid(spark, _S, _S).join(low, ["y", "x"], "left").select("y", "x", (F.coalesce("v", F.lit(0.0)) * 8).alias("v"))


def _nodes(spark, d) -> DataFrame:
    return settle(surfaces.surface_nodes(settle(_hill(spark, d)), _S))


@query(f"{_NODES} SELECT x, y, z, cast(mask AS int) AS mask FROM nodes")
def surface_nodes(spark, d):
    return _nodes(spark, d)


@query(f"{_MESH} SELECT vid, x, y, z, (vz::bigint << 32) | (vy::bigint << 16) | vx::bigint AS sig FROM vert")
def mesh_vertices(spark, d):
    v = surfaces.vertices(_nodes(spark, d), _S)
    return v.select("vid", "x", "y", "z", S.vertex_signature(F.col("vx"), F.col("vy"), F.col("vz")).alias("sig"))


@query(f"{_MESH} SELECT x, y, z, k, v0, v1, v2, v3 FROM qv")
def mesh_quads(spark, d):
    n = _nodes(spark, d)
    q = surfaces.quads(n).join(surfaces.vertices(n, _S).select("vid", "vx", "vy", "vz"), ["vx", "vy", "vz"])
    return q.groupBy("x", "y", "z", "k").agg(*[F.max(F.when(F.col("j") == j, F.col("vid"))).alias(f"v{j}") for j in range(4)])


@query(f"{_MESH} SELECT tid, x, y, z, k, t, a, b, c FROM tri")
def mesh_triangles(spark, d):
    return settle(surfaces.numbered(surfaces.triangles(_nodes(spark, d), _S)))


_SLOT = f"{_MESH}, vt AS (SELECT tid, k, t, unnest([a, b, c]) AS vid FROM tri), slot AS (SELECT vid, k, t, max(tid) AS tid FROM vt GROUP BY vid, k, t)"


@query(f"{_SLOT} SELECT * FROM slot")
def vert_tri_slots(spark, d):
    return surfaces.slots(settle(surfaces.numbered(surfaces.triangles(_nodes(spark, d), _S))))


def _round(src: str, dst: str) -> str:
    return f"{dst} AS (SELECT v.vid, 0.98 * v.x + 0.02 * m.x AS x, 0.98 * v.y + 0.02 * m.y AS y, 0.98 * v.z + 0.02 * m.z AS z FROM {src} v JOIN (SELECT vid, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z FROM (SELECT s.vid, unnest([a, b, c]) AS o FROM slot s JOIN tri USING (tid)) n JOIN (SELECT vid AS o, x, y, z FROM {src}) o USING (o) GROUP BY vid) m USING (vid))"


@query(f"{_SLOT}, {_round('vert', 's1')}, {_round('s1', 's2')} SELECT vid, cast(floor(x * 100000 + 0.37) AS bigint) AS x, cast(floor(y * 100000 + 0.37) AS bigint) AS y, cast(floor(z * 100000 + 0.37) AS bigint) AS z FROM s2")
def smooth2(spark, d):
    n = _nodes(spark, d)
    t = settle(surfaces.numbered(surfaces.triangles(n, _S)))
    return surfaces.smooth(surfaces.vertices(n, _S), surfaces.slots(t), t, 0.98, 2).select("vid", *[F.floor(F.col(a) * 100000 + 0.37).alias(a) for a in "xyz"])


_NEAR = f"{_SLOT}, near AS MATERIALIZED (SELECT vid, o, count(*) AS m FROM (SELECT s.vid, unnest([a, b, c]) AS o FROM slot s JOIN tri USING (tid)) GROUP BY vid, o), deg AS MATERIALIZED (SELECT vid, sum(m) AS t FROM near GROUP BY vid)"


@query(f"{_NEAR}, go AS (SELECT 0 AS k, vid, x, y, z FROM vert UNION ALL SELECT any_value(g.k) + 1, n.vid, " + ", ".join(f"0.98 * sum(CASE WHEN n.o = -1 THEN g.{a} ELSE 0 END) + 0.02 * sum(CASE WHEN n.o = -1 THEN 0 ELSE n.m * g.{a} END) / any_value(d.t)" for a in "xyz") + " FROM (SELECT vid, o, m, o AS src FROM near UNION ALL SELECT vid, -1, 0, vid FROM deg) n JOIN go g ON g.vid = n.src JOIN deg d ON d.vid = n.vid WHERE g.k < 200 GROUP BY n.vid) SELECT vid, cast(floor(x * 100000 + 0.37) AS bigint) AS x, cast(floor(y * 100000 + 0.37) AS bigint) AS y, cast(floor(z * 100000 + 0.37) AS bigint) AS z FROM go WHERE k = 200", recursive=True)
def smooth200(spark, d):
    """J1 with all its rounds, by tiles with halos."""
    n = _nodes(spark, d)
    t = settle(surfaces.numbered(surfaces.triangles(n, _S)))
    done = surfaces.smooth_tiles(settle(surfaces.vertices(n, _S)), surfaces.slots(t), t, 0.98, 200, cells=8, rings=25)
    return done.select("vid", *[F.floor(F.col(a) * 100000 + 0.37).alias(a) for a in "xyz"])


@query(f"{_MESH} SELECT tid, a AS u, b AS v FROM tri UNION ALL SELECT tid, b, c FROM tri UNION ALL SELECT tid, c, a FROM tri")
def wireframe(spark, d):
    return surfaces.wireframe(settle(surfaces.numbered(surfaces.triangles(_nodes(spark, d), _S))))


@query(f"{_MESH} SELECT vid, 0 AS \"end\", x, y, z FROM vert UNION ALL SELECT vid, 1, x + 0.0, y + 0.0, z + 0.5 FROM vert")
def normal_lines(spark, d):
    v = surfaces.vertices(_nodes(spark, d), _S).select("vid", "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return surfaces.normal_lines(v, 0.5)


@query(f"{_MESH}, m AS (SELECT max(z) AS h FROM vert) SELECT vid, 1::double AS r, z / h AS g, (z / h) * (z / h) AS b, x AS u, 1 - y AS v FROM vert, m")
def vertex_colors(spark, d):
    return surfaces.vertex_colors(surfaces.vertices(_nodes(spark, d), _S))


_BITS = ", ".join(f"coalesce(max(n) FILTER (i = {k}), 0) AS c{k}" for k in range(8))
_CELLS = f"{VOX}, co(i, ox, oy, oz) AS (VALUES " + ", ".join(str((k, *c)) for k, c in enumerate(surfaces.CORNERS)) + f"), s AS (SELECT x - ox AS x, y - oy AS y, z - oz AS z, i, n FROM vox, co), cell AS (SELECT s.x, s.y, s.z, {_BITS} FROM s WHERE EXISTS (SELECT 1 FROM vox v WHERE v.x = s.x AND v.y = s.y AND v.z = s.z) GROUP BY 1, 2, 3), cube AS (SELECT *, " + " + ".join(f"(CASE WHEN c{k} < 3 THEN {1 << k} ELSE 0 END)" for k in range(8)) + " AS cube FROM cell)"


@query(f"{_CELLS} SELECT x, y, z, cast(cube AS int) AS cube FROM cube")
def mc_cube_index(spark, d):
    return surfaces.cube_index(surfaces.cells(vox(spark, d), LEVEL), 3.0).select("x", "y", "z", "cube")


_COUNT = "cnt(cube, n) AS (VALUES " + ", ".join(f"({i}, {len(surfaces.cube_triangles(i))})" for i in range(256)) + ")"


@query(f"{_CELLS}, {_COUNT} SELECT cast(cube AS int) AS cube, count(*) AS cells, cast(sum(n) AS bigint) AS triangles FROM cube JOIN cnt USING (cube) WHERE n > 0 GROUP BY cube")
def mc_triangle_count(spark, d):
    v = vox(spark, d)
    t = surfaces.marching_cubes(v, LEVEL, 3.0).where("corner = 0").groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    c = surfaces.cube_index(surfaces.cells(v, LEVEL), 3.0).select("x", "y", "z", "cube")
    return c.join(t, ["x", "y", "z"]).groupBy("cube").agg(F.count("*").alias("cells"), F.sum("n").alias("triangles"))


_CASES = "cases(cube, seq, corner, i, j, ix, iy, iz, jx, jy, jz) AS (VALUES " + ", ".join(str((c, s, k, *surfaces.EDGES[e], *(p for end in surfaces.EDGES[e] for p in surfaces.CORNERS[end]))) for c in range(256) for s, t in enumerate(surfaces.cube_triangles(c)) for k, e in enumerate(t)) + ")"


@query(
    f"{_CELLS}, {_CASES}, ends AS (SELECT cube.x, cube.y, cube.z, seq, corner, ix, iy, iz, jx, jy, jz, cast([c0, c1, c2, c3, c4, c5, c6, c7][i + 1] AS double) AS v, cast([c0, c1, c2, c3, c4, c5, c6, c7][j + 1] AS double) AS w FROM cube JOIN cases USING (cube)), "
    "way AS (SELECT *, CASE WHEN abs(3 - v) < 1e-5 THEN 0 WHEN abs(3 - w) < 1e-5 THEN 1 WHEN abs(v - w) < 1e-5 THEN 0 ELSE (3 - v) / (w - v) END AS t FROM ends) SELECT x, y, z, seq, corner, " + ", ".join(f"round(({a} + i{a} + t * (j{a} - i{a})) / 32::double, 6) AS p{a}" for a in "xyz") + " FROM way"
)
def mc_triangles(spark, d):
    return surfaces.marching_cubes(vox(spark, d), LEVEL, 3.0).select("x", "y", "z", "seq", "corner", *r6("px", "py", "pz"))


@query("n AS (SELECT a.r AS i, b.r AS j FROM range(17) a(r), range(33) b(r)) SELECT cast(i AS int) AS i, cast(j AS int) AS j, round(sin(i * (pi() / 16)) * cos(j * (2 * pi() / 32)), 6) + 0.0 AS x, round(sin(i * (pi() / 16)) * sin(j * (2 * pi() / 32)), 6) + 0.0 AS y, round(cos(i * (pi() / 16)), 6) + 0.0 AS z FROM n")
def sphere_mesh(spark, d):
    return surfaces.sphere_mesh(spark).select("i", "j", *_r0("x", "y", "z"))


@query()
def delaunay_tets(spark, d):
    p = pts(spark, d)
    edge = surfaces.delaunay_edge(p)
    return surfaces.delaunay_tiles(p, edge, edge / 2)


# --- tile trees ---------------------------------------------------------------------------------------------------------------------


def tile_tree(spark, d) -> DataFrame:
    """root, regions, nations, suppliers as a tree of spheres."""
    bv = lambda k: F.struct(F.lit("sphere").alias("type"), F.array(*[((k * m) % 16).cast("double") for m in (3, 5, 7)], F.lit(1.0)).alias("vals"))
    x = F.array(*[F.lit(v) for v in tiles3d.IDENTITY])
    none = F.lit(None).cast("array<double>")
    row = lambda t, i, p, g, r, k, m=none: t.select(i.alias("tile_id"), p.alias("parent_id"), F.lit(g).cast("double").alias("geo_error"), F.lit(r).cast("string").alias("refine"), bv(k).alias("bv"), m.alias("xform"))
    root = row(spark.range(1), F.lit("t"), F.lit(None).cast("string"), 64.0, "REPLACE", F.col("id"), x)
    reg = row(table(spark, d, "region"), F.concat(F.lit("r"), "r_regionkey"), F.lit("t"), 16.0, "ADD", F.col("r_regionkey"), F.array(*[F.lit(2.0) if i in (0, 5, 10) else F.lit(v) for i, v in enumerate(tiles3d.IDENTITY)]))
    nat = row(table(spark, d, "nation"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), 4.0, "REPLACE", F.col("n_nationkey"), F.array(*[F.col("n_nationkey").cast("double") if i == 3 else F.lit(v) for i, v in enumerate(tiles3d.IDENTITY)]))
    sup = row(table(spark, d, "supplier"), F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), None, None, F.col("s_suppkey"))
    return root.unionByName(reg).unionByName(nat).unionByName(sup)


_SPH = lambda k: f"{k} * 3 % 16 AS cx, {k} * 5 % 16 AS cy, {k} * 7 % 16 AS cz"
_T3 = f"t3 AS (SELECT 't' AS tile_id, NULL::varchar AS parent_id, 64::double AS geo_error, 'REPLACE' AS refine, {_SPH(0)}, 1::double AS s, 0::double AS tx UNION ALL SELECT 'r' || r_regionkey, 't', 16, 'ADD', {_SPH('r_regionkey')}, 2, 0 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 4, 'REPLACE', {_SPH('n_nationkey')}, 1, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, NULL, NULL, {_SPH('s_suppkey')}, NULL, NULL FROM supplier)"
_INH = f"{_T3}, inh AS (SELECT *, 0 AS depth FROM t3 WHERE parent_id IS NULL UNION ALL SELECT c.tile_id, c.parent_id, coalesce(c.geo_error, p.geo_error), coalesce(c.refine, p.refine), c.cx, c.cy, c.cz, p.s * coalesce(c.s, 1), p.tx + p.s * coalesce(c.tx, 0), p.depth + 1 FROM t3 c JOIN inh p ON c.parent_id = p.tile_id)"


@query(f"{_INH} SELECT tile_id, parent_id, depth, geo_error, refine, s AS m00, tx AS m03 FROM inh", recursive=True)
def inherit(spark, d):
    t = tiles3d.inherit(tile_tree(spark, d))
    return t.select("tile_id", "parent_id", "depth", "geo_error", "refine", F.element_at("xform", 1).alias("m00"), F.element_at("xform", 4).alias("m03"))


_EYE, _H, _U = (8.0, 8.0, 40.0), 20.0, 1.5
_SSE = f"{_INH}, mv AS (SELECT *, s * cx + tx AS mx, s * cy AS my, s * cz AS mz FROM inh), se AS (SELECT *, sqrt((mx - 8) * (mx - 8) + (my - 8) * (my - 8) + (mz - 40) * (mz - 40)) AS dist FROM mv), er AS (SELECT *, 20 * geo_error * 1.5::double / dist AS sse FROM se)"


def _errors(spark, d) -> DataFrame:
    t = tiles3d.inherit(tile_tree(spark, d))
    t = t.withColumn("bv", F.struct(F.col("bv.type").alias("type"), tiles3d.move_volume(F.col("bv.type"), F.col("bv.vals"), F.col("xform")).alias("vals")))
    return tiles3d.with_error(t, _EYE, _H, _U)


@query(f"{_SSE} SELECT tile_id, mx AS cx, my AS cy, mz AS cz, round(dist, 6) AS dist, round(sse, 6) AS sse FROM er", recursive=True)
def sse(spark, d):
    return _errors(spark, d).select("tile_id", *[F.element_at("bv.vals", k + 1).alias(c) for k, c in enumerate(("cx", "cy", "cz"))], *r6("dist", "sse"))


_VISIT = f"{_SSE}, vis AS (SELECT * FROM er WHERE parent_id IS NULL UNION ALL SELECT c.* FROM er c JOIN vis p ON c.parent_id = p.tile_id WHERE p.sse >= 10)"


@query(f"{_VISIT} SELECT tile_id, depth FROM vis", recursive=True)
def lod_visit(spark, d):
    return tiles3d.visited(_errors(spark, d)).select("tile_id", "depth")


@query(f"{_VISIT} SELECT tile_id, depth, refine FROM vis v WHERE refine = 'ADD' OR NOT EXISTS (SELECT 1 FROM vis c WHERE c.parent_id = v.tile_id)", recursive=True)
def lod_render_set(spark, d):
    return tiles3d.drawn(tiles3d.visited(_errors(spark, d))).select("tile_id", "depth", "refine")


#: a camera that goes up and down over the tiles, a frame for each hour of events
_PATH = "hours AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), fr AS (SELECT row_number() OVER (ORDER BY h) - 1 AS frame, n FROM hours), eye AS (SELECT frame, cast(8 + n % 3 AS double) AS ex, 8::double AS ey, cast(4 + abs(frame * 3 % 80 - 40) + n % 3 AS double) AS ez FROM fr)"
# what is open is told by runs of frames: a tile d levels down opens when its ancestor at level j has had a large error for d - j + 1 frames
_OPEN = (
    f"{_INH}, {_PATH}, mv AS (SELECT *, s * cx + tx AS mx, s * cy AS my, s * cz AS mz FROM inh), big AS (SELECT frame, tile_id, parent_id, depth, 20 * geo_error * 1.5::double / sqrt((mx - ex) * (mx - ex) + (my - ey) * (my - ey) + (mz - ez) * (mz - ez)) >= 10 AS b FROM mv CROSS JOIN eye), "
    "run AS (SELECT frame, tile_id, parent_id, depth, CASE WHEN b THEN frame - coalesce(max(CASE WHEN NOT b THEN frame END) OVER (PARTITION BY tile_id ORDER BY frame), -1) ELSE 0 END AS r FROM big), "
    "least_ AS (SELECT frame, tile_id, depth, r AS m FROM run WHERE parent_id IS NULL UNION ALL SELECT c.frame, c.tile_id, c.depth, least(p.m, c.r + c.depth) FROM run c JOIN least_ p ON p.frame = c.frame AND p.tile_id = c.parent_id), "
    "op AS MATERIALIZED (SELECT frame, tile_id, depth, m > depth AS open FROM least_)"
)


def _path(spark, d) -> DataFrame:
    t = tiles3d.inherit(tile_tree(spark, d))
    moved = tiles3d.move_volume(F.col("bv.type"), F.col("bv.vals"), F.col("xform"))
    t = t.withColumns({"bv": F.struct(F.col("bv.type").alias("type"), moved.alias("vals")), "tileset": F.lit(0)})
    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    f, n = F.col("rank"), F.col("n")
    frames = points.ranked(hours, "h").select(F.lit(0).alias("tileset"), f.alias("frame"), (8 + n % 3).cast("double").alias("ex"), F.lit(8.0).alias("ey"), (4 + F.abs(f * 3 % 80 - 40) + n % 3).cast("double").alias("ez"))
    return tiles3d.along(t, frames, _H, _U)


@query(f"{_OPEN}, st AS (SELECT o.frame, o.tile_id, o.depth, o.open FROM op o LEFT JOIN t3 USING (tile_id) LEFT JOIN op p ON p.tile_id = t3.parent_id AND p.frame = o.frame LEFT JOIN (SELECT tile_id, min(frame) AS f FROM op WHERE open GROUP BY tile_id) b ON b.tile_id = o.tile_id WHERE CASE WHEN t3.parent_id IS NULL THEN o.frame >= b.f ELSE p.open END) SELECT frame, tile_id, depth, open FROM st", recursive=True)
def lod_path(spark, d):
    """K3: the states of tiles in every frame of a camera path."""
    return _path(spark, d).select("frame", "tile_id", "depth", "open")


@query(f"{_OPEN}, ch AS (SELECT frame, tile_id, open, lag(open, 1, FALSE) OVER (PARTITION BY tile_id ORDER BY frame) AS was FROM op) SELECT frame, tile_id, open AS opened FROM ch WHERE open <> was", recursive=True)
def lod_transitions(spark, d):
    """K3: what opens and closes from frame to frame."""
    return tiles3d.transitions(_path(spark, d)).select("frame", "tile_id", "opened")


@query("m AS (SELECT n_nationkey::double AS n FROM nation) SELECT n, n * 2 AS m00, n + 1 AS m03, 2 * n AS m11, n * n + 2 AS px FROM m")
def mat_mul(spark, d):
    n = F.col("n_nationkey").cast("double")
    i = tiles3d.IDENTITY
    a = F.array(*[n if k in (0, 5, 10) else F.lit(1.0) if k == 3 else F.lit(v) for k, v in enumerate(i)])
    b = F.array(*[F.lit(2.0) if k in (0, 5, 10) else F.lit(1.0) if k == 3 else F.lit(v) for k, v in enumerate(i)])
    t = table(spark, d, "nation").select(n.alias("n"), S.matmul4(a, b).alias("m"), S.transform3(a, F.array(n, F.lit(0.0), F.lit(0.0))).alias("p"))
    return t.select("n", F.element_at("m", 1).alias("m00"), F.element_at("m", 4).alias("m03"), F.element_at("m", 6).alias("m11"), (F.element_at("p", 1) + 1.0).alias("px"))


@query("q AS (SELECT n_nationkey::double AS n, sin(n_nationkey * 0.1::double) AS z, cos(n_nationkey * 0.1::double) AS w FROM nation) SELECT n, round((1 - 2 * z * z) * 2, 6) AS m00, round(-2 * z * w * 3, 6) + 0.0 AS m01, round(2 * z * w * 2, 6) + 0.0 AS m10, n AS m03, round((1 - 2 * z * z) * 2, 6) AS l00, round(-2 * z * w * 2, 6) + 0.0 AS l01 FROM q")
def trs_compose(spark, d):
    n = F.col("n_nationkey").cast("double")
    q = [F.lit(0.0), F.lit(0.0), F.sin(n * 0.1), F.cos(n * 0.1)]
    s = [F.lit(2.0), F.lit(3.0), F.lit(4.0)]
    t = table(spark, d, "nation").select(n.alias("n"), S.trs([n, F.lit(0.0), F.lit(0.0)], q, s).alias("m"), S.trs([n, F.lit(0.0), F.lit(0.0)], q, s, legacy=True).alias("l"))
    return t.select("n", *[(F.round(F.element_at(c, k), 6) + 0.0).alias(a) for a, c, k in (("m00", "m", 1), ("m01", "m", 2), ("m10", "m", 5), ("l00", "l", 1), ("l01", "l", 2))], F.element_at("m", 4).alias("m03"))


# --- graphs -------------------------------------------------------------------------------------------------------------------------

_EDGES = "ge AS (SELECT c_nationkey AS u, s_nationkey AS v, count(*) AS c FROM (SELECT o_custkey, l_suppkey FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), e AS (SELECT cast(u AS int) AS u, cast(v AS int) AS v, cast(c AS int) AS c FROM ge WHERE u <> v)"


def gedges(spark, d, *more: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    j = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("p")), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("u")), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("v")), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.where("u <> v").groupBy("u", "v", *more).agg(F.count("*").cast("int").alias("c"))


_MANY = "me AS (SELECT c_nationkey AS u, s_nationkey AS v, o_orderpriority AS p, count(*) AS c FROM (SELECT o_custkey, o_orderpriority, l_suppkey FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"


@query(_MANY + ", r AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY c, p) AS k FROM me WHERE u <> v) SELECT cast(u AS int) AS u, cast(v AS int) AS v, p, cast(c AS int) AS c FROM r WHERE k = 1")
def graph_edges(spark, d):
    """Of the edges of each priority between two nations, the least."""
    return graphs.distinct_edges(gedges(spark, d, "p").select("u", "v", "p", "c"), "c", "p")


@query(_EDGES + ", b AS (SELECT 0 AS node, 0 AS hop UNION SELECT e.v, hop + 1 FROM b JOIN e ON e.u = b.node WHERE hop < (SELECT count(*) FROM nation)) SELECT cast(node AS int) AS node, cast(min(hop) AS int) AS hop FROM b GROUP BY node", recursive=True)
def bfs_hops(spark, d):
    return graphs.hops(gedges(spark, d), 0)


#: a network of orders: the source 0 to customers, customers to the suppliers of their lines, suppliers to the sink 1
_NET = "li AS (SELECT o_custkey * 2 + 2 AS cu, l_suppkey * 2 + 3 AS su FROM lineitem JOIN orders ON o_orderkey = l_orderkey), net AS (SELECT cu AS u, su AS v, count(*) AS c FROM li GROUP BY 1, 2 UNION ALL SELECT 0, cu, (count(*) * 3 + 3) // 4 FROM li GROUP BY cu UNION ALL SELECT su, 1, CASE WHEN su % 4 = 1 THEN count(*) * 2 ELSE count(*) // 4 END FROM li GROUP BY su)"


def network(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = li.groupBy((F.col("o_custkey") * 2 + 2).cast("long").alias("u"), (F.col("l_suppkey") * 2 + 3).cast("long").alias("v")).agg(F.count("*").alias("c"))
    lines = settle(lines)
    give = lines.groupBy(F.col("u").alias("v")).agg(F.expr("(sum(c) * 3 + 3) div 4").alias("c")).select(F.lit(0).cast("long").alias("u"), "v", "c")
    take = lines.groupBy(F.col("v").alias("u")).agg(F.sum("c").alias("n")).select("u", F.lit(1).cast("long").alias("v"), F.expr("CASE WHEN u % 4 = 1 THEN n * 2 ELSE n div 4 END").alias("c"))
    return lines.unionByName(give).unionByName(take)


def _checks(flow: DataFrame, **exprs) -> DataFrame:
    """A row (check, n) for each of these aggregates of one row."""
    one = flow.agg(*[F.coalesce(e, F.lit(0)).cast("long").alias(k) for k, e in exprs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in exprs])).alias("x")).select("x.*")


@query(f"{_NET}, n AS (SELECT count(*) AS arcs, sum(c) AS c FROM net) SELECT 'arcs' AS \"check\", arcs AS n FROM n UNION ALL SELECT 'capacity', cast(c AS bigint) FROM n UNION ALL SELECT 'beyond capacity', 0 UNION ALL SELECT 'unbalanced nodes', 0 UNION ALL SELECT 'flow less cut', 0")
def maxflow(spark, d):
    """The flow's proof, a row for each check: its arcs are the network's, none carries too much, nodes pass on what they get, and it equals a cut."""
    arcs = settle(network(spark, d))
    f = settle(graphs.max_flow(arcs, 0, 1))
    side = graphs.cut_sides(f, 0)
    at = lambda c: side.select(F.col("node").alias(c), F.col("side").alias(f"s{c}"))
    both = arcs.withColumnRenamed("c", "cap").join(f, ["u", "v"], "full").join(at("u"), "u", "left").join(at("v"), "v", "left")
    value = F.sum(F.when(F.col("v") == 1, F.col("flow")))
    cut = F.sum(F.when((F.col("su") == "S") & (F.col("sv") == "T"), F.col("cap")))
    bad = F.col("flow").isNull() | F.col("cap").isNull() | (F.col("flow") < 0) | (F.col("flow") > F.col("cap"))
    first = _checks(both, **{"arcs": F.count("cap"), "capacity": F.sum("cap"), "beyond capacity": F.count_if(bad), "flow less cut": value - cut})
    ends = f.select(F.explode(F.array(F.struct(F.col("u").alias("node"), (-F.col("flow")).alias("d")), F.struct(F.col("v").alias("node"), F.col("flow").alias("d")))).alias("x")).groupBy("x.node").agg(F.sum("x.d").alias("d"))
    return first.unionByName(_checks(ends, **{"unbalanced nodes": F.count_if((F.col("d") != 0) & ~F.col("node").isin(0, 1))}))


@query(f"{_NET}, node AS (SELECT u AS node FROM net UNION SELECT v FROM net) SELECT 'nodes' AS \"check\", count(*) AS n FROM node UNION ALL SELECT 'source in S', 1 UNION ALL SELECT 'sink in T', 1 UNION ALL SELECT 'arcs from S to T with room', 0 UNION ALL SELECT 'arcs from T to S with flow', 0")
def mincut_sets(spark, d):
    """The cut's proof: every node has a side, and no arc between the sides could carry more to the sink."""
    f = settle(graphs.max_flow(network(spark, d), 0, 1))
    side = settle(graphs.cut_sides(f, 0))
    at = lambda c: side.select(F.col("node").alias(c), F.col("side").alias(f"s{c}"))
    both = f.join(at("u"), "u").join(at("v"), "v")
    across = _checks(both, **{"arcs from S to T with room": F.count_if((F.col("su") == "S") & (F.col("sv") == "T") & (F.col("flow") < F.col("c"))), "arcs from T to S with flow": F.count_if((F.col("su") == "T") & (F.col("sv") == "S") & (F.col("flow") > 0))})
    sides = _checks(side, **{"nodes": F.count_distinct("node"), "source in S": F.count_if((F.col("node") == 0) & (F.col("side") == "S")), "sink in T": F.count_if((F.col("node") == 1) & (F.col("side") == "T"))})
    return across.unionByName(sides)


@query(_EDGES + " SELECT 'digraph {' || chr(10) || string_agg('  ' || u || ' -> ' || v || ' [label=\"0/' || c || '\"];', chr(10) ORDER BY u, v) || chr(10) || '}' AS dot FROM e")
def graph_dot(spark, d):
    return graphs.dot(gedges(spark, d).withColumn("flow", F.lit(0)))
