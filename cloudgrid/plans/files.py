"""Queries over files that the query itself writes to the shared folder, over streams, and over functions that need no points; each with its SQL.

Importing this module adds them to those of ``harness``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.lineage import fresh, settle
from ..operators import points, surfaces, tiles3d, voxels
from ..sources import gltf, las, raster, store, tiff, tileset
from ..sources import sink as single
from ..streaming import counts
from .harness import _CORNERS, _MESH, _S, _TWO, LEVEL, MAP, PTS, _nodes, files, img, pts, query, r6, table, vox

# --- LAS ----------------------------------------------------------------------------------------------------------------------------

_ORDER = ["x", "y", "z", "inten"]
_FILES = f"{PTS}, lp AS (SELECT file_id || '.las' AS file, row_number() OVER (PARTITION BY file_id ORDER BY x, y, z, inten) - 1 AS pt_idx, x, y, z, cast(floor(inten) AS bigint) % 65536 AS intensity FROM fpts)"


def _las(spark, d) -> str:
    """A folder of LAS files, one for each file_id; the points are multiples of the scale, so nothing is rounded."""
    at = fresh(spark, "las")
    las.write_files(pts(spark, d, "inten", "file_id"), at, "file_id", _ORDER, 1 / 4096, "inten")
    return at


def _name() -> F.Column:
    return F.substring_index("path", "/", -1).alias("file")


@query(f"{_FILES} SELECT file, count(*) AS n_points, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, 1 / 4096::double AS scale FROM lp GROUP BY file")
def las_headers(spark, d):
    """A1, A2."""
    return las.scan(spark, _las(spark, d), headers=True).select(_name(), "n_points", "min_x", "min_y", "max_x", "max_y", F.col("scale.x").alias("scale"))


@query(f"{_FILES} SELECT file, pt_idx, x, y, z, cast(intensity AS int) AS intensity FROM lp")
def las_points(spark, d):
    """A4, A5."""
    return las.scan(spark, _las(spark, d)).select(_name(), "pt_idx", "x", "y", "z", "intensity")


_INSIDE = "inside AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pt_idx) - 1 AS k FROM lp WHERE x >= {0} AND x <= {2} AND y >= {1} AND y <= {3})"


@query(f"{_FILES}, {_INSIDE.format(0.25, 0.125, 0.5, 0.75)} SELECT file, pt_idx, x, y, z FROM inside WHERE k % 8 = 0")
def las_area_stride(spark, d):
    """A3."""
    return las.load_area(spark, _las(spark, d), 0.25, 0.125, 0.5, 0.75, 8).select(_name(), "pt_idx", "x", "y", "z")


@query(f"{_FILES}, {_INSIDE.format(0.375, 0.25, 0.5, 0.375)} SELECT file, pt_idx, x, y, z FROM inside WHERE k % 2 = 0")
def las_tile_load(spark, d):
    """X2, D2 over headers."""
    return las.load_tile(spark, _las(spark, d), 3, 2, 0.125, 2).select(_name(), "pt_idx", "x", "y", "z")


def _store(spark, d) -> str:
    """The points as a store of small files and pages, as the tables are small."""
    at = fresh(spark, "store")
    store.write(pts(spark, d, "inten"), at, rows=4000, page=200)
    return at


@query(f"{PTS} SELECT x, y, z, inten FROM pts WHERE x >= 0.25 AND x <= 0.5 AND y >= 0.125 AND y <= 0.75")
def store_area(spark, d):
    """A3, C2 over points in the order of a curve."""
    return store.area(spark, _store(spark, d), 0.25, 0.125, 0.5, 0.75)


@query(f"{PTS} SELECT x, y, z, inten FROM pts WHERE x >= 0.375 AND x <= 0.5 AND y >= 0.25 AND y <= 0.375")
def store_tile(spark, d):
    """X2 over points in the order of a curve."""
    return store.tile(spark, _store(spark, d), 3, 2, 0.125)


_GRID8 = f"{PTS}, f AS (SELECT file_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM fpts GROUP BY file_id), t AS (SELECT a.r AS tx, b.r AS ty, a.r / 8.0::double AS x0, b.r / 8.0::double AS y0 FROM range(8) a(r), range(8) b(r)), pairs AS (SELECT file_id, cast(tx AS bigint) AS tx, cast(ty AS bigint) AS ty FROM f, t WHERE min_x <= x0 + 0.125 AND max_x >= x0 AND min_y <= y0 + 0.125 AND max_y >= y0)"


@query(f"{_GRID8} SELECT file_id, tx, ty FROM pairs WHERE tx = (SELECT min(tx) FROM pairs) + 2 AND ty = (SELECT min(ty) FROM pairs) + 5")
def tile_by_index(spark, d):
    """X1."""
    return points.tile_at(points.tile_file_pairs(files(spark, d), 0.125), 2, 5, relative=True).select("file_id", "tx", "ty")


@query(f"{PTS} SELECT row_number() OVER (ORDER BY z, x, y, inten) - 1 AS rank, x, y, z, inten FROM pts")
def sort_points(spark, d):
    """F1, F2."""
    return points.ranked(pts(spark, d, "inten"), "z", "x", "y", "inten").select("rank", "x", "y", "z", "inten")


@query(f"{PTS}, e AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x), max(y), max(z)) AS h FROM pts) SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def denormalize_per_axis(spark, d):
    """B12 and back."""
    p = pts(spark, d)
    e = p.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))]).first()
    return points.denormalize_per_axis(points.normalize_per_axis(p), (e.lx, e.ly, e.lz), max(e.hx, e.hy, e.hz)).select(*r6("x", "y", "z"))


@query("g AS (SELECT 1 / 16::double + b.r / 19::double AS x, 1 / 16::double + c.r / 19::double AS y, 1 / 16::double + a.r / 19::double AS z FROM range(16) a(r), range(16) b(r), range(16) c(r)) SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN abs(x - 0.5) < 0.2::double OR abs(y - 0.5) < 0.2::double OR abs(z - 0.5) < 0.2::double THEN 0::double ELSE 1::double END AS val FROM g")
def slab_lattice(spark, d):
    """A25, third volume."""
    return points.slab_lattice(spark, 16).select(*r6("x", "y", "z"), "val")


@query(f"{PTS}, h AS (SELECT x * 0.5::double AS x, y * 0.5::double AS y, z * 0.5::double AS z FROM pts) SELECT x, y, z, 1::double AS val FROM h WHERE sqrt(x * x + y * y + z * z) >= 0.3::double")
def shell_points(spark, d):
    """A25, first volume: its random candidates are the table's points."""
    return points.shell_points(pts(spark, d))


def _bal(coarse: str, fine: str, out: str, size: int) -> str:
    return f"{out}_p AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, (x & 1) * 2 - 1 AS sx, (y & 1) * 2 - 1 AS sy, (z & 1) * 2 - 1 AS sz FROM {fine}), {out}_c AS (SELECT x + sx AS x, y, z FROM {out}_p UNION SELECT x, y + sy, z FROM {out}_p UNION SELECT x, y, z + sz FROM {out}_p UNION SELECT x + sx, y + sy, z + sz FROM {out}_p WHERE sx = sy AND sy = sz), {out} AS (SELECT x, y, z, val FROM {coarse} UNION ALL SELECT x, y, z, 1e-9::double FROM {out}_c c WHERE x BETWEEN 0 AND {size - 1} AND y BETWEEN 0 AND {size - 1} AND z BETWEEN 0 AND {size - 1} AND NOT EXISTS (SELECT 1 FROM {coarse} b WHERE b.x = c.x AND b.y = c.y AND b.z = c.z))"


@query(f"{_TWO}, b4 AS (SELECT * FROM coarse WHERE val >= 30), all3 AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, sum(val) AS val FROM coarse GROUP BY 1, 2, 3), b3 AS (SELECT * FROM all3 WHERE val >= 200), {_bal('b4', 'fine', 'o4', 16)}, {_bal('b3', 'o4', 'o3', 8)} SELECT 4 AS lvl, x, y, z, val FROM o4 UNION ALL SELECT 3, x, y, z, val FROM o3")
def balance_levels(spark, d):
    """I5, the whole loop."""
    v = vox(spark, d)
    c4 = voxels.coarser(v)
    c3 = voxels.coarser(c4)
    out = voxels.balance({5: v.where("n >= 4"), 4: c4.where("val >= 30"), 3: c3.where("val >= 200"), 2: voxels.coarser(c3)})
    return out[4].withColumn("lvl", F.lit(4)).unionByName(out[3].withColumn("lvl", F.lit(3))).select("lvl", "x", "y", "z", "val")


# --- rasters ------------------------------------------------------------------------------------------------------------------------


def _image_file(spark, d, name: str, make) -> DataFrame:
    """(path, content) of one file made of the 64 x 64 heightmap."""
    at = fresh(spark, "raster")

    def one(key, t):
        v = np.zeros((64, 64))
        v[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("v").to_numpy()
        return pa.table({"name": pa.array([name]), "content": pa.array([make(v)], pa.binary())})

    single.write_each(img(spark, d).select("y", "x", "v").groupBy(F.lit(0).alias("image")).applyInArrow(one, "name string, content binary"), at)
    return spark.read.format("binaryFile").load(at).where(F.col("path").endswith(name))


def _tiff(spark, d) -> DataFrame:
    return _image_file(spark, d, "map.tif", lambda v: raster.tiff_bytes(v[:, :, None].astype(np.float32), (100.0, 200.0), (0.5, 0.5), 2))


@query("SELECT 'map.tif' AS file, 64 AS width, 64 AS height, 1 AS bands, 32 AS bits, 100::double AS a, 0.5::double AS b, 0::double AS c, 200::double AS d, 0::double AS e, -0.5::double AS f, 3 AS levels, 64 AS block_w, 64 AS block_h")
def raster_meta(spark, d):
    """A6."""
    return raster.read_meta(_tiff(spark, d)).select(_name(), *[c.split()[0] for c in raster.META.split(", ")[1:]])


@query(f"{MAP} SELECT 'map.tif' AS file, y, x, 0 AS band, v FROM img")
def raster_pixels(spark, d):
    """Pixels of a file."""
    return raster.read_pixels(_tiff(spark, d)).select(_name(), "y", "x", "band", "v")


@query(f"{MAP} SELECT y // 2 AS y, x // 2 AS x, v FROM img WHERE y % 2 = 0 AND x % 2 = 0")
def raster_overview(spark, d):
    """An overview's pixels."""
    return raster.read_pixels(_tiff(spark, d), 1).select("y", "x", "v")


@query(f"{MAP}, o AS (SELECT cast(a.r AS int) AS oy, cast(b.r AS int) AS ox FROM range(24) a(r), range(24) b(r)) SELECT oy, ox, coalesce(v, 0::double) AS v FROM o LEFT JOIN img ON img.x = ox + 48 AND img.y = oy - 4")
def raster_tile_window(spark, d):
    """A box in the raster's frame that goes beyond its border."""
    return points.raster_of_tile(img(spark, d), (100.0, 0.5, 0.0, 200.0, 0.0, -0.5), 124.0, 190.0, 136.0, 202.0, 24)


@query(f"{MAP} SELECT y, x, v FROM img WHERE y >= 16 AND y < 32 AND x >= 32 AND x < 48")
def raster_block_file(spark, d):
    """A block of the Parquet layout, whose other blocks' files are pruned."""
    at = fresh(spark, "blocks")
    raster.write_blocks(img(spark, d).select("y", "x", "v"), at, 16)
    return points.raster_block(raster.read_blocks(spark, at), 1, 2, 16)


@query(f"{MAP} SELECT 'map.png' AS file, y, x, 0 AS band, floor(v * 64) AS v FROM img")
def png_decode(spark, d):
    """A20."""
    return raster.read_png(_image_file(spark, d, "map.png", lambda v: raster.png_bytes(np.floor(v * 64).astype(np.uint8)[:, :, None], (0, 1, 2, 3, 4)))).select(_name(), "y", "x", "band", "v")


def _mosaic(spark, d) -> str:
    """The heightmap as four tiled files with two overviews."""
    at = fresh(spark, "mosaic")
    single.write_each(tiff.mosaic(img(spark, d), 32, 16, 2, 0.5), at)
    return at


@query("SELECT r || '_' || c || '.tif' AS file, cast(l AS int) AS lvl, cast(32 // (1 << l) AS int) AS width, cast(32 // (1 << l) AS int) AS height, 1 AS bands, 16 AS block_w, c * 16::double AS a, 0.5::double AS b, r * -16::double AS d, -0.5::double AS f FROM (SELECT DISTINCT (l_orderkey % 2) AS r FROM lineitem), (SELECT DISTINCT (l_orderkey % 2) AS c FROM lineitem), range(3) x(l)")
def tiff_levels(spark, d):
    """The levels of every file of a folder."""
    return tiff.scan(spark, _mosaic(spark, d), levels=True).select(_name(), "lvl", "width", "height", "bands", "block_w", "a", "b", "d", "f")


@query(f"{MAP} SELECT y // 32 || '_' || x // 32 || '.tif' AS file, cast((y % 32) // 16 AS int) AS by_, cast((x % 32) // 16 AS int) AS bx, cast(y % 32 AS int) AS y, cast(x % 32 AS int) AS x, v FROM img WHERE (y % 32) // 16 = 1")
def tiff_blocks(spark, d):
    """A row of blocks of every file, by byte ranges."""
    return tiff.scan(spark, _mosaic(spark, d)).where("lvl = 0 and by = 1").select(_name(), F.col("by").alias("by_"), "bx", "y", "x", "v")


@query(f"{MAP}, o AS (SELECT cast(a.r AS int) AS oy, cast(b.r AS int) AS ox FROM range(6) a(r), range(6) b(r)) SELECT oy, ox, coalesce(v, 0::double) AS v FROM o LEFT JOIN img ON img.x = 2 * (ox + 3) AND img.y = 32 + 2 * (oy + 2)")
def tiff_window(spark, d):
    """A window of one file at half its resolution comes from its first overview."""
    return tiff.window(spark, f"{_mosaic(spark, d)}/1_0.tif", 6, 4, 18, 16, 6, 6)


# --- text, tilesets and models ------------------------------------------------------------------------------------------------------


@query("n AS (SELECT n_regionkey || '.txt' AS file, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey) SELECT file, text, cast(strlen(text) AS bigint) AS length FROM n")
def text_files(spark, d):
    """Whole files as text and as bytes."""
    at = fresh(spark, "text")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])).alias("t"))
    single.write_each(rows.select(F.concat("n_regionkey", F.lit(".txt")).alias("name"), F.encode("t", "UTF-8").alias("content")), at)
    text = spark.read.text(at, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value").alias("text"))
    size = spark.read.format("binaryFile").load(at).select(_name(), "length")
    return text.join(size, "file").select("file", "text", "length")


_SPHERE = "[({k} * 3 % 16)::double, ({k} * 5 % 16)::double, ({k} * 7 % 16)::double, 1::double]"


@query(
    "r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), n AS (SELECT n.*, r.i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation n JOIN r ON r_regionkey = n_regionkey), "
    f"t AS (SELECT '0' AS tile_id, NULL::varchar AS parent_id, 0 AS depth, 64::double AS geo_error, 'REPLACE' AS refine, NULL::varchar AS uri, {_SPHERE.format(k=0)} AS v UNION ALL SELECT '0.' || i, '0', 1, 16, 'ADD', NULL, {_SPHERE.format(k='r_regionkey')} FROM r UNION ALL SELECT '0.' || i || '.' || j, '0.' || i, 2, 4, NULL, n_name || '.b3dm', {_SPHERE.format(k='n_nationkey')} FROM n) "
    "SELECT tile_id, parent_id, cast(depth AS int) AS depth, geo_error, refine, uri, 'sphere' AS kind, v[1] AS cx, v[4] AS radius FROM t"
)
def tileset_tiles(spark, d):
    """A13."""
    ball = lambda k: F.struct(F.array(*[((F.col(k) if k else F.lit(0)) * m % 16).cast("double") for m in (3, 5, 7)], F.lit(1.0)).alias("sphere")).alias("boundingVolume")
    kids = lambda t, by: t.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tile"))), lambda x: x["tile"]).alias("children"))
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("k"), F.struct(ball("n_nationkey"), F.lit(4.0).alias("geometricError"), F.struct(F.concat("n_name", F.lit(".b3dm")).alias("uri")).alias("content")).alias("tile"))
    r = table(spark, d, "region").join(kids(n, ["n_regionkey"]), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    r = r.select(F.col("r_regionkey").alias("k"), F.struct(ball("r_regionkey"), F.lit(16.0).alias("geometricError"), F.lit("ADD").alias("refine"), "children").alias("tile"))
    root = kids(r, []).select(F.to_json(F.struct(F.struct(F.lit("1.0").alias("version")).alias("asset"), F.struct(ball(""), F.lit(64.0).alias("geometricError"), F.lit("REPLACE").alias("refine"), "children").alias("root"))).alias("j"))
    at = fresh(spark, "tileset")
    single.write_each(root.select(F.lit("tileset.json").alias("name"), F.encode("j", "UTF-8").alias("content")), at)
    t = tileset.read_tilesets(spark.read.format("binaryFile").load(at))
    return t.select("tile_id", "parent_id", "depth", "geo_error", "refine", "uri", F.col("bv.type").alias("kind"), F.element_at("bv.vals", 1).alias("cx"), F.element_at("bv.vals", 4).alias("radius"))


def _entity_tables(spark, d) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each region as a model: a node and a view of its name's bytes for every nation, two meshes, three accessors."""
    n = table(spark, d, "nation")
    order = lambda: F.row_number().over(points.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    before = points.Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(points.Window.unboundedPreceding, -1)
    n = n.select(F.concat(F.lit("r"), "n_regionkey").alias("model_id"), "n_regionkey", "n_name", order().cast("int").alias("idx"), F.coalesce(F.sum(F.octet_length("n_name")).over(before), F.lit(0)).cast("int").alias("at"))
    model = n.groupBy("model_id").agg(F.count("*").cast("int").alias("k"), F.sum(F.octet_length("n_name")).cast("int").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n_name"))), lambda x: x["n_name"]), "").alias("all"))
    two = model.withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1))))
    kinds = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("component_type"), F.lit(t).alias("data_type"), F.lit(o).alias("byte_offset")) for i, (c, t, o) in enumerate(((5126, "VEC3", 0), (5121, "VEC4", 12), (5123, "SCALAR", 0)))])
    tables = {
        "nodes": n.select("model_id", "idx", (F.col("idx") % 2).alias("mesh"), F.array(*map(F.lit, tiles3d.IDENTITY)).alias("xform"), F.when(F.col("idx") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("children")),
        "buffers": model.select("model_id", F.lit(0).alias("idx"), F.col("size").alias("byte_length"), F.lit(None).cast("string").alias("uri")),
        "buffer_views": n.select("model_id", "idx", F.lit(0).alias("buffer"), F.octet_length("n_name").alias("byte_length"), F.col("at").alias("byte_offset"), F.lit(0).alias("byte_stride"), F.lit(34962).alias("target")),
        "accessors": model.select("model_id", "k", F.explode(kinds).alias("e")).select("model_id", "e.idx", (F.col("e.idx") % F.col("k")).alias("buffer_view"), "e.byte_offset", "e.component_type", "e.data_type", F.col("k").alias("count"), F.array(F.col("k").cast("double")).alias("max"), F.array(F.lit(0.0)).alias("min")),
        "meshes": two.select("model_id", "idx", F.concat(F.lit("mesh"), "idx").alias("name")),
        "primitives": two.select("model_id", F.col("idx").alias("mesh"), F.lit(0).alias("idx"), F.create_map(F.lit("POSITION"), F.lit(0), F.lit("COLOR_0"), F.lit(1)).alias("attribs"), F.lit(2).alias("indices"), F.lit(-1).alias("material"), (F.col("idx") * 3 + 1).alias("mode")),
        "scenes": model.select("model_id", F.lit(0).alias("idx"), F.lit("all").alias("name"), F.array(F.lit(0)).alias("base_nodes")),
    }
    return tables, model.select("model_id", F.encode("all", "UTF-8").alias("bin"))


def _models(spark, d, end: str = "glb") -> DataFrame:
    """The models written as files of this ending and read again."""
    at = fresh(spark, "models")
    made = settle(gltf.from_tables(*_entity_tables(spark, d)))
    packed = gltf.write_models(made) if end != "gltf" else made.select("model_id", F.encode("json", "UTF-8").alias("content"))
    packed = gltf.as_b3dm(packed) if end == "b3dm" else packed
    single.write_each(packed.select(F.concat("model_id", F.lit(f".{end}")).alias("name"), "content"), at)
    return settle(gltf.read_models(spark.read.format("binaryFile").load(at)).withColumn("model_id", F.substring_index("model_id", "/", -1)))


_REG = "g AS (SELECT n_nationkey, n_regionkey, n_name, 'r' || n_regionkey AS m, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS int) AS i, cast(coalesce(sum(strlen(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS o FROM nation), m AS (SELECT m, cast(count(*) AS int) AS k, cast(sum(strlen(n_name)) AS int) AS size FROM g GROUP BY m)"
_ACC = "acc(idx, ct, name, bytes, dt, n, o) AS (VALUES (0, 5126, 'FLOAT', 4, 'VEC3', 3, 0), (1, 5121, 'UNSIGNED_BYTE', 1, 'VEC4', 4, 12), (2, 5123, 'UNSIGNED_SHORT', 2, 'SCALAR', 1, 0))"


@query(f"{_REG} SELECT m || '.glb' AS model_id, i AS idx, i % 2 AS mesh, 1::double AS m00, CASE WHEN i = 0 THEN '1,2' ELSE '' END AS children FROM g")
def gltf_nodes(spark, d):
    """Nodes through a GLB file."""
    t = gltf.entities(_models(spark, d))["nodes"]
    return t.select("model_id", "idx", "mesh", F.element_at("xform", 1).alias("m00"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query(f"{_REG}, {_ACC} SELECT m || '.b3dm' AS model_id, idx, cast(idx % k AS int) AS buffer_view, o AS byte_offset, ct AS component_type, name AS component, bytes, dt AS data_type, n AS components, k AS count, k::double AS most FROM m, acc")
def gltf_accessors(spark, d):
    """A14, A17, A18, H-enum: accessors through a b3dm file."""
    t = gltf.entities(_models(spark, d, "b3dm"))["accessors"]
    return t.select("model_id", "idx", "buffer_view", "byte_offset", "component_type", S.component_name(F.col("component_type")).alias("component"), S.component_bytes(F.col("component_type")).alias("bytes"), "data_type", S.data_type_count(F.col("data_type")).alias("components"), "count", F.element_at("max", 1).alias("most"))


@query(f"{_REG}, e(entity) AS (VALUES ('buffers'), ('scenes'), ('meshes'), ('primitives'), ('accessors'), ('nodes'), ('buffer_views')) SELECT m || '.gltf' AS model_id, entity, cast(CASE WHEN entity IN ('nodes', 'buffer_views') THEN k WHEN entity = 'accessors' THEN 3 WHEN entity IN ('meshes', 'primitives') THEN 2 ELSE 1 END AS bigint) AS n FROM m, e")
def gltf_summary(spark, d):
    """A18, A22, H-json: counts of a model's entities through a glTF file."""
    return gltf.summary(gltf.entities(_models(spark, d, "gltf")))


@query(f"{_REG}, {_ACC}, a(attribute, accessor) AS (VALUES ('POSITION', 0), ('COLOR_0', 1)), p(mesh, mode) AS (VALUES (0, 1), (1, 4)) SELECT m.m || '.glb' AS model_id, mesh, 0 AS primitive, attribute, accessor, dt AS data_type, m.k AS count, g.o AS byte_offset, cast(strlen(g.n_name) AS int) AS byte_length FROM m, a JOIN acc ON acc.idx = accessor, p JOIN g ON g.m = m.m AND g.i = acc.idx % m.k")
def gltf_attributes(spark, d):
    """D14."""
    t = gltf.attributes(gltf.entities(_models(spark, d)))
    return t.select("model_id", "mesh", "primitive", "attribute", "accessor", "data_type", "count", "byte_offset", "byte_length")


@query(f"{_REG} SELECT m || '.glb' AS model_id, i AS idx, n_name AS text FROM g")
def gltf_view_bytes(spark, d):
    """X4."""
    m = _models(spark, d)
    return gltf.view_bytes(m, gltf.entities(m)).select("model_id", "idx", F.decode("data", "UTF-8").alias("text"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'data:text/plain;base64,' || to_base64(encode(n_name)) ELSE 'names/' || n_nationkey || '.txt' END AS uri, n_name AS text FROM nation")
def gltf_resolve(spark, d):
    """Data URIs and names of files."""
    n = table(spark, d, "nation").select("n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content"), (F.col("n_nationkey") % 2 == 0).alias("inline"))
    at = fresh(spark, "names")
    single.write_each(n, at)
    uris = n.select(F.when(F.col("inline"), F.concat(F.lit("data:text/plain;base64,"), F.base64("content"))).otherwise(F.concat(F.lit("names/"), "name")).alias("uri"))
    return gltf.resolve(uris, spark.read.format("binaryFile").load(at)).select("uri", F.decode("content", "UTF-8").alias("text"))


@query(f"{_MESH} SELECT 'v' AS kind, vid AS id, x, y, z FROM vert UNION ALL SELECT 't', tid, a, b, c FROM tri")
def mesh_sink(spark, d):
    """A mesh through the sink of its two tables."""
    at, n = fresh(spark, "mesh"), _nodes(spark, d)
    surfaces.vertices(n, _S).select("vid", "x", "y", "z").write.parquet(f"{at}/vertices")
    surfaces.numbered(surfaces.triangles(n, _S)).select("tid", "a", "b", "c").write.parquet(f"{at}/triangles")
    v = spark.read.parquet(f"{at}/vertices").select(F.lit("v").alias("kind"), F.col("vid").alias("id"), "x", "y", "z")
    t = spark.read.parquet(f"{at}/triangles").select(F.lit("t").alias("kind"), F.col("tid").alias("id"), *[F.col(a).cast("double").alias(b) for a, b in zip("abc", "xyz", strict=True)])
    return v.unionByName(t)


@query(f"{_CORNERS}, tri(t, i, j) AS (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (1, 2, 0)) SELECT cast(k * 2 + t AS int) AS tid, cast(k AS int) AS k, cast(CASE WHEN k IN ({', '.join(str(k) for k, f in enumerate(surfaces.FACE_FLIPS) if f)}) THEN 2 - i ELSE i END AS int) AS corner, ox * 2::double - 1 AS x, oy * 2::double - 1 AS y, oz * 2::double - 1 AS z FROM corner JOIN tri USING (j)")
def box_mesh(spark, d):
    """I9."""
    return surfaces.box_mesh(spark)


# --- transforms and cameras -------------------------------------------------------------------------------------------------------------


def _n(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("n"))


def _arr(*v) -> F.Column:
    return F.array(*S._row(*v))


def _r(c, k: int) -> F.Column:
    return F.round(F.element_at(c, k), 6) + 0.0


@query("m AS (SELECT n_nationkey::double AS n FROM nation) SELECT n, cast(r.r AS int) AS row, cast(c.r AS int) AS col, CASE WHEN r.r = c.r THEN 1::double ELSE 0::double END AS v FROM m, range(4) r(r), range(4) c(r)")
def inverse_transpose(spark, d):
    """A matrix' transpose times its inverse transpose is the identity."""
    n = F.col("n")
    m = [n + 2, 1, 0, 3, 0.5, 3, 1, n, 1, 0, n + 4, 1, 0, 0.25, 0, 1]
    t = _n(spark, d).withColumns({"a": _arr(*[m[c * 4 + r] for r in range(4) for c in range(4)]), "b": S.inverse_transpose(_arr(*m))}).withColumn("p", S.matmul4(F.col("a"), F.col("b")))
    return t.select("n", F.posexplode("p").alias("i", "v")).select("n", F.expr("i div 4").cast("int").alias("row"), (F.col("i") % 4).alias("col"), (F.round("v", 6) + 0.0).alias("v"))


@query("m AS (SELECT n_nationkey::double AS n, cos(n_nationkey * 0.1::double) AS c, sin(n_nationkey * 0.1::double) AS s FROM nation) SELECT n, round(c, 6) + 0.0 AS v00, round(-(c * n - s * 2 * n), 6) + 0.0 AS v03, round(-(s * n + c * 2 * n), 6) + 0.0 AS v13, -3::double AS v23, round(n, 6) AS x, round(2 * n, 6) AS y, 3::double AS z, round(s, 6) + 0.0 AS r01, round(1 / tan(radians((40 + n) * 0.5)), 6) AS p00, round(1000.5 / 999.5::double, 6) AS p22, round(-1000 / 999.5::double, 6) AS p23 FROM m")
def camera_pose(spark, d):
    """View of a pose, pose of that view, projection."""
    n = F.col("n")
    c, s = F.cos(n * 0.1), F.sin(n * 0.1)
    t = _n(spark, d).withColumn("view", S.view_of_pose(_arr(c, -s, 0, s, c, 0, 0, 0, 1), _arr(n, n * 2, 3)))
    turn, at = S.pose_of_view(F.col("view"))
    t = t.withColumns({"turn": turn, "at": at, "p": S.projection(n + 40, n + 30, 0.5, 1000.0)})
    return t.select("n", _r("view", 1).alias("v00"), _r("view", 4).alias("v03"), _r("view", 8).alias("v13"), _r("view", 12).alias("v23"), *[_r("at", k + 1).alias(a) for k, a in enumerate("xyz")], _r("turn", 2).alias("r01"), _r("p", 1).alias("p00"), _r("p", 11).alias("p22"), _r("p", 12).alias("p23"))


@query("m AS (SELECT n_nationkey::double AS n, 2 - n_nationkey::double AS dx, n_nationkey::double AS dy, -2::double AS dz FROM nation), f AS (SELECT n, dx / sqrt(dx * dx + dy * dy + 4) AS fx, dy / sqrt(dx * dx + dy * dy + 4) AS fy, dz / sqrt(dx * dx + dy * dy + 4) AS fz FROM m), s AS (SELECT *, fy / sqrt(fx * fx + fy * fy) AS sx, -fx / sqrt(fx * fx + fy * fy) AS sy FROM f) SELECT n, round(sx, 6) + 0.0 AS m00, round(sy, 6) + 0.0 AS m01, round(sx * n + sy, 6) + 0.0 AS m03, round(sy * fz, 6) + 0.0 AS m10, round(fx, 6) + 0.0 AS m20, round(fx * n + fy + fz * 2, 6) + 0.0 AS m23, round(2 / (n + 2), 6) AS p00, round(n / (n + 2), 6) AS p02, round(11 / 9::double, 6) AS p22, round(-20 / 9::double, 6) AS p23 FROM s")
def look_at_frustum(spark, d):
    """X13."""
    n = F.col("n")
    m = S.look_at(S._row(n, 1, 2), [F.lit(2.0), n + 1.0, F.lit(0.0)], S._row(0, 0, 1))
    p = S.frustum(F.lit(-1.0), n + 1.0, F.lit(-1.0), F.lit(1.0), F.lit(1.0), F.lit(10.0))
    t = _n(spark, d).withColumns({"m": m, "p": p})
    return t.select("n", *[_r("m", k).alias(a) for a, k in (("m00", 1), ("m01", 2), ("m03", 4), ("m10", 5), ("m20", 9), ("m23", 12))], *[_r("p", k).alias(a) for a, k in (("p00", 1), ("p02", 3), ("p22", 11), ("p23", 12))])


@query("b AS (SELECT n_nationkey::double AS n FROM nation), k(kind) AS (VALUES ('sphere'), ('box'), ('region')) SELECT n, kind, CASE kind WHEN 'sphere' THEN 2 * n + 1 WHEN 'box' THEN 2 * n + 1 ELSE n END AS v1, CASE kind WHEN 'sphere' THEN 4::double WHEN 'box' THEN 2 * 4 + 1 ELSE 4::double END AS v4, CASE kind WHEN 'box' THEN 2 * 5 + n ELSE 5::double END AS v5 FROM b, k WHERE kind <> 'sphere' UNION ALL SELECT n, 'sphere', 2 * n + 1, 4::double, NULL FROM b")
def move_volumes(spark, d):
    """Sphere, box and region."""
    n = F.col("n")
    x = _arr(2, 0, 0, 1, 0, 2, 0, n, 0, 0, 2, 0, 0, 0, 0, 1)
    t = _n(spark, d).withColumn("kind", F.explode(F.array(*map(F.lit, ("sphere", "box", "region")))))
    t = t.withColumn("vals", F.when(F.col("kind") == "sphere", _arr(n, 2, 3, 4)).when(F.col("kind") == "box", _arr(n, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)).otherwise(_arr(n, 2, 3, 4, 5, 6)))
    t = t.withColumn("moved", tiles3d.move_volume(F.col("kind"), F.col("vals"), x))
    return t.select("n", "kind", F.element_at("moved", 1).alias("v1"), F.element_at("moved", 4).alias("v4"), F.try_element_at("moved", F.lit(5)).alias("v5"))


def _series(s: str, terms) -> str:
    return " + ".join(s.format(a=repr(a), j=2 * j) for j, a in enumerate(terms, 1))


@query(
    f"{PTS}, l AS (SELECT DISTINCT x * 360 - 180 AS lon, y * 160 - 80 AS lat FROM pts), z AS (SELECT *, (floor((lon + 180) / 6)::int % 60 + 60) % 60 + 1 AS zone FROM l), "
    f"t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS d, sinh(atanh(sin(radians(lat))) - {S.UTM_E!r} * atanh({S.UTM_E!r} * sin(radians(lat)))) AS t FROM z), "
    "x AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t) "
    f"SELECT lon, lat, cast(zone AS int) AS zone, round(500000 + {S.UTM_SCALE * S.UTM_RADIUS!r} * (eta + {_series('{a} * cos({j} * xi) * sinh({j} * eta)', S.UTM_FORWARD)}), 2) AS east, "
    f"round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {S.UTM_SCALE * S.UTM_RADIUS!r} * (xi + {_series('{a} * sin({j} * xi) * cosh({j} * eta)', S.UTM_FORWARD)}), 2) AS north, "
    "cast(floor(lon * 100000 + 0.37) AS bigint) AS blon, cast(floor(lat * 100000 + 0.37) AS bigint) AS blat FROM x"
)
def utm(spark, d):
    """To UTM and back."""
    p = pts(spark, d).select((F.col("x") * 360.0 - 180.0).alias("lon"), (F.col("y") * 160.0 - 80.0).alias("lat")).distinct().withColumn("zone", S.utm_zone(F.col("lon")))
    e, n = S.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    p = p.withColumns({"east": e, "north": n})
    lon, lat = S.utm_back(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return p.select("lon", "lat", "zone", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), F.floor(lon * 100000 + 0.37).alias("blon"), F.floor(lat * 100000 + 0.37).alias("blat"))


@query("SELECT p_partkey AS v, CASE WHEN p_partkey > 1 THEN cast(floor(log2(p_partkey) + 1e-12) AS int) ELSE 0 END AS l FROM part")
def int_log2(spark, d):
    """H-log2."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("v"), S.int_log2(F.col("p_partkey")).alias("l"))


@query("q AS (SELECT n_nationkey::double AS n, sin(n_nationkey * 0.1::double) AS z, cos(n_nationkey * 0.1::double) AS w FROM nation) SELECT n, (5::bigint << 59) | (n::bigint << 38) | (2::bigint << 19) | 1 AS k, 5 AS kd, cast(n AS int) AS kz, cast(floor(log2(n + 1)) AS int) AS l, round((1 - 2 * z * z) * 2, 6) + 0.0 AS t00, round(-2 * z * w * 3, 6) + 0.0 AS t01, n AS t03, 2 * n + 1 AS px, 27::bigint AS cells FROM q")
def sql_functions(spark, d):
    """N: the registered SQL functions."""
    S.register(spark)
    _n(spark, d).createOrReplaceTempView("cloudgrid_n")
    one = ", ".join(str(v) for v in tiles3d.IDENTITY)
    return spark.sql(
        "SELECT n, k, voxel_d(k) kd, voxel_z(k) kz, int_log2(cast(n + 1 AS bigint)) l, round(element_at(m, 1), 6) + 0.0D t00, round(element_at(m, 2), 6) + 0.0D t01, element_at(m, 4) t03, element_at(mat_vec(mat_mul(array(2D, 0D, 0D, 1D, 0D, 2D, 0D, 0D, 0D, 0D, 2D, 0D, 0D, 0D, 0D, 1D), "
        f"cast(array({one}) AS array<double>)), array(n, 0D, 0D)), 1) px, (SELECT count(*) FROM nbrs(1)) cells FROM (SELECT n, voxel_key(5, 1, 2, cast(n AS bigint)) k, trs_matrix(array(n, 0D, 0D), array(0D, 0D, sin(n * 0.1D), cos(n * 0.1D)), array(2D, 3D, 4D)) m FROM cloudgrid_n)"
    )


@query(f"{PTS} SELECT cast(floor(x * 32) AS int) AS x, cast(floor(y * 32) AS int) AS y, cast(floor(z * 32) AS int) AS z, count(*) AS n FROM pts WHERE z < 1 GROUP BY 1, 2, 3")
def stream_voxel_counts(spark, d):
    """M: voxel counts over points that arrive in files, a few of them in each batch."""
    at = fresh(spark, "stream")
    pts(spark, d).repartition(6).write.parquet(f"{at}/in")
    points_ = spark.readStream.schema("x double, y double, z double").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")

    counts.keep_counts(points_, LEVEL, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("x", "y", "z", "n")
