"""Points, tiles and rasters: filters, coordinate frames, spatial overlap and lookups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..functions.scalar import CHART

AXES = ("x", "y", "z")


def confine_z(points: DataFrame) -> DataFrame:
    """Points with z in [0, 1)."""
    return points.where("z >= 0 and z < 1")


def area(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points of a closed rectangle; plain comparisons, so sources prune by them."""
    return points.where((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def stride_sample(points: DataFrame, stride: int, part: str, order: list[str]) -> DataFrame:
    """Every stride-th point of each file, by its order there (all columns, where rows have no key).

    Points are ranked over all files, so a file's points are ordered by several tasks; a file's first rank is taken off.
    """
    placed = ranked(points, part, *order)
    first = placed.groupBy(F.col(part).alias("_part")).agg(F.min("rank").alias("_first"))
    return placed.join(first, placed[part].eqNullSafe(F.col("_part"))).where((F.col("rank") - F.col("_first")) % stride == 0).select(*points.columns)


def ranked(rows: DataFrame, *cols: str) -> DataFrame:
    """rows with ``rank``, their place from 0 in the order of these columns.

    Sorted by ranges of values; a task numbers its own rows, and only the sizes of the ranges are added up in one place.
    """
    own = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    own = settle(own.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    n = own.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    before = n.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return own.join(before, "_p").withColumn("rank", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def with_bounds(points: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Points beside the one row of these aggregates (broadcast: it is one row)."""
    return points.crossJoin(F.broadcast(points.agg(*[e.alias(n) for n, e in exprs.items()])))


BINS, EXACT = 4096, 1 << 16


def exact_quantiles(points: DataFrame, wanted: dict[str, tuple[float, ...]]) -> dict[str, list[float]]:
    """Quantiles (interpolated between neighbours in order) of columns, without one task that holds all values.

    The ranks asked for are closed in on by counted passes: each splits the interval of every open rank into BINS and keeps the bin with
    it, until the bins hold EXACT distinct values together at most; these are counted exactly.  All columns and ranks go through a pass
    together, and only counts of bins and the last values reach the driver.
    """
    cols = list(wanted)
    ok = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols}
    first = points.agg(*[f(F.when(ok[c], F.col(c).cast("double"))).alias(f"{n}_{k}") for k, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ranks, spans = {}, {}
    for k, c in enumerate(cols):
        n = first[f"n_{k}"]
        at = [q * (n - 1) for q in wanted[c]] if n else []
        ranks[c] = at
        for r in sorted({int(np.floor(x)) for x in at} | {int(np.ceil(x)) for x in at}):
            spans[c, r] = (first[f"lo_{k}"], first[f"hi_{k}"], 0, n)  # from, to (both included), rows before, rows inside
    value: dict[tuple[str, int], float] = {}
    while spans:
        boxes = sorted({(c, s[0], s[1]) for (c, _), s in spans.items()})
        small = [(c, lo, hi) for c, lo, hi in boxes if lo == hi or max(s[3] for (d, _), s in spans.items() if (d, s[0], s[1]) == (c, lo, hi)) <= EXACT]
        rows = []
        for b, (c, lo, hi) in enumerate(boxes):
            v = F.col(c).cast("double")
            if (c, lo, hi) in small:
                place = v
            else:
                place = F.least(F.floor((v - lo) / (hi - lo) * float(BINS)), F.lit(BINS - 1)).cast("double")
            rows.append(F.when(ok[c] & (v >= lo) & (v <= hi), F.struct(F.lit(b).alias("b"), place.alias("p"), v.alias("v"))))
        hit = points.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("e.*")
        counted: dict[int, list] = {}
        for r in hit.groupBy("b", "p").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counted.setdefault(r.b, []).append((r.p, r.n, r.lo, r.hi))
        bins = {box: sorted(counted.get(b, [])) for b, box in enumerate(boxes)}
        for (c, r), (lo, hi, before, _) in list(spans.items()):
            for _, n, low, high in bins[c, lo, hi]:
                if r < before + n:
                    if low == high:
                        value[c, r] = low
                        del spans[c, r]
                    else:
                        spans[c, r] = (low, high, before, n)
                    break
                before += n
    return {c: [value[c, int(np.floor(x))] + (value[c, int(np.ceil(x))] - value[c, int(np.floor(x))]) * (x - np.floor(x)) for x in at] or [None] * len(wanted[c]) for c, at in ranks.items()}


def quantile_trim(points: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Points strictly between two quantiles of each axis."""
    for a, (lo, hi) in exact_quantiles(points, limits).items():
        points = points.where((F.col(a) > F.lit(lo)) & (F.col(a) < F.lit(hi)))
    return points


def quantile_window(points: DataFrame, xy: float = 0.05, z: tuple[float, float] = (1e-7, 0.99995)) -> DataFrame:
    """Scaled by the largest edge of a quantile box, and confined to the open unit cube."""
    q = exact_quantiles(points, {"x": (xy, 1 - xy), "y": (xy, 1 - xy), "z": z})
    if q["x"][0] is None:
        return points.limit(0)
    edge = max(q[a][1] - q[a][0] for a in AXES)
    moved = points.withColumns({a: (F.col(a) - q[a][0]) / edge for a in AXES})
    return moved.where(" and ".join(f"{a} > 0 and {a} < 1" for a in AXES))


def _extents() -> dict[str, Column]:
    return {f"_lo_{a}": F.min(a) for a in AXES} | {f"_hi_{a}": F.max(a) for a in AXES}


def normalize_unit(points: DataFrame, cap: float = 800.0) -> DataFrame:
    """Z clamped to [min, min + cap], then one scale for all axes, just below 1."""
    both = with_bounds(points, _extents()).withColumn("_hi_z", F.least("_hi_z", F.col("_lo_z") + cap)).withColumn("z", F.least("z", "_hi_z"))
    scale = F.lit(0.99999) / F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in AXES])
    return both.withColumn("_s", scale).withColumns({a: (F.col(a) - F.col(f"_lo_{a}")) * F.col("_s") for a in AXES}).drop("_s", *_extents())


def normalize_signed(points: DataFrame) -> DataFrame:
    """To [-1, 1] by the largest extent."""
    both = with_bounds(points, _extents()).withColumn("_e", F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in AXES]))
    return both.withColumns({a: (F.col(a) - F.col(f"_lo_{a}")) / F.col("_e") * 2.0 - 1.0 for a in AXES}).drop("_e", *_extents())


def normalize_per_axis(points: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Each axis by the largest upper bound less its own lower one."""
    both = with_bounds(points, _extents()).withColumn("_h", F.greatest("_hi_x", "_hi_y", "_hi_z"))
    return both.withColumns({a: (F.col(a) - F.col(f"_lo_{a}")) / (F.col("_h") - F.col(f"_lo_{a}") + eps) for a in AXES}).drop("_h", *_extents())


def denormalize_per_axis(points: DataFrame, lo: tuple[float, float, float], high: float, eps: float = 1e-4) -> DataFrame:
    """Back from ``normalize_per_axis``, given the lower bounds and the largest upper one."""
    return points.withColumns({a: F.col(a) * (high - l + eps) + l for a, l in zip(AXES, map(float, lo), strict=True)})


def las_rescale(points: DataFrame, raw: dict[str, str], scale: dict[str, float], offset: dict[str, float], origin: dict[str, float] | None = None) -> DataFrame:
    """Metres of raw whole numbers (axis -> column), relative to an origin: raw * scale - (origin - offset)."""
    o = origin or {}
    return points.withColumns({a: F.col(c) * scale[a] - F.lit(float(o.get(a, 0.0)) - float(offset[a])) for a, c in raw.items()})


def tile_at(tiles: DataFrame, tx: int, ty: int, relative: bool = False) -> DataFrame:
    """The tile of an index, absolute or counted from the least of the table."""
    if not relative:
        return tiles.where((F.col("tx") == tx) & (F.col("ty") == ty))
    low = tiles.agg(F.min("tx").alias("_x"), F.min("ty").alias("_y"))
    return tiles.crossJoin(F.broadcast(low)).where((F.col("tx") - F.col("_x") == tx) & (F.col("ty") - F.col("_y") == ty)).drop("_x", "_y")


def tile_points(points: DataFrame, pairs: DataFrame, tx: int, ty: int, edge: float, file: str = "path", order: str | None = None, stride: int = 1) -> DataFrame:
    """The points of a tile: those in its closed box, of each of its files (D2), every stride-th by their order there."""
    own = pairs.where((F.col("tx") == tx) & (F.col("ty") == ty)).select(file)
    inside = area(points.join(own, file, "left_semi"), tx * edge, ty * edge, (tx + 1) * edge, (ty + 1) * edge)
    return inside if stride == 1 else stride_sample(inside, stride, file, [order])


def tile_window(x0: float, y0: float, x1: float, y1: float, geo: tuple) -> tuple[float, float, float, float]:
    """The window in pixels (left, top, right, bottom) of a box in the frame of a raster of this geotransform."""
    m = affine_inverse(geo)
    at = [(m[0] + m[1] * x + m[2] * y, m[3] + m[4] * x + m[5] * y) for x, y in ((x0, y0), (x1, y1))]
    return min(at[0][0], at[1][0]), min(at[0][1], at[1][1]), max(at[0][0], at[1][0]), max(at[0][1], at[1][1])


def raster_of_tile(pixels: DataFrame, geo: tuple, x0: float, y0: float, x1: float, y1: float, size: int = 4096, bilinear: bool = False) -> DataFrame:
    """A tile's box as a square raster of ``size`` pixels."""
    left, top, right, bottom = tile_window(x0, y0, x1, y1, geo)
    return raster_window(pixels, left, top, right, bottom, size, size, bilinear)


def affine_inverse(m: tuple) -> tuple:
    """Inverse of x' = a + b*px + c*py, y' = d + e*px + f*py, on the driver."""
    a, b, c, d, e, f = m
    inv = np.linalg.inv(np.array([[b, c, a], [e, f, d], [0, 0, 1]], float))
    return inv[0, 2], inv[0, 0], inv[0, 1], inv[1, 2], inv[1, 0], inv[1, 1]


def affine(x: Column, y: Column, m: tuple) -> tuple[Column, Column]:
    """B7."""
    a, b, c, d, e, f = (float(v) for v in m)
    return F.lit(a) + x * b + y * c, F.lit(d) + x * e + y * f


def tile_edge(level: int) -> float:
    """B2: metres."""
    return CHART / (1 << level)


def tile_of(v: Column, level: int, high: bool = False) -> Column:
    """B4."""
    t = v / CHART * float(1 << level)
    return (F.ceil(t) if high else F.floor(t)).cast("int")


def extent(files: DataFrame) -> DataFrame:
    """Box over all files."""
    return files.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def tile_file_pairs(files: DataFrame, edge: float, overlap: float = 0.0) -> DataFrame:
    """Tiles whose closed box meets a file's closed box.

    Each file names the tiles it may meet (from ceil - 1, as boxes are closed), so no pair of boxes is compared otherwise; the grid is that of
    the floor and ceiling of all files' extent, one broadcast row.
    """
    grid = extent(files).select(*[F.floor(F.col(f"min_{a}") / edge).alias(f"_g0{a}") for a in "xy"], *[F.ceil(F.col(f"max_{a}") / edge).alias(f"_g1{a}") for a in "xy"])
    both = files.crossJoin(F.broadcast(grid))
    for a in "xy":
        lo = F.greatest(F.ceil((F.col(f"min_{a}") - overlap) / edge) - 1, F.col(f"_g0{a}"))
        hi = F.least(F.floor((F.col(f"max_{a}") + overlap) / edge), F.col(f"_g1{a}") - 1)
        both = both.where(lo <= hi).withColumn(f"t{a}", F.explode(F.sequence(lo, hi)))
    return both.drop("_g0x", "_g0y", "_g1x", "_g1y")


def files_per_tile(pairs: DataFrame, file: str = "path") -> DataFrame:
    """E20."""
    return pairs.groupBy("tx", "ty").agg(F.array_sort(F.collect_list(file)).alias("files"), F.count("*").alias("n"))


def gather_pixels(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The pixel under each point that lies in the raster."""
    at = points.withColumns({"px": F.floor(F.col("x") * float(width)).cast("int"), "py": F.floor(F.col("y") * float(height)).cast("int")})
    at = at.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}")
    return at.join(pixels, (at.px == pixels.x) & (at.py == pixels.y)).select(at["*"], pixels.v)


def block_grid(width: int, height: int, block: int, levels: int, spark) -> DataFrame:
    """All blocks of all overview levels with their extent in full-resolution pixels."""
    lv = spark.range(levels).select(F.col("id").cast("int").alias("lvl"))
    n = lambda size: (F.floor((F.floor(F.lit(size) / F.call_function("shiftleft", F.lit(1), F.col("lvl"))) + (block - 1)) / block)).cast("int")
    b = lv.withColumn("by", F.explode(F.sequence(F.lit(0), n(height) - 1))).withColumn("bx", F.explode(F.sequence(F.lit(0), n(width) - 1)))
    edge = F.call_function("shiftleft", F.lit(block), F.col("lvl"))
    return b.select("lvl", "by", "bx", (F.col("bx") * edge).alias("x0"), (F.col("by") * edge).alias("y0"), ((F.col("bx") + 1) * edge).alias("x1"), ((F.col("by") + 1) * edge).alias("y1"))


def grid(spark, height: int, width: int) -> DataFrame:
    """Dense pixel grid (y, x)."""
    return spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def raster_window(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float, out_w: int, out_h: int, bilinear: bool = False) -> DataFrame:
    """A window in pixels, resampled; what lies outside the raster is 0."""
    g = grid(pixels.sparkSession, out_h, out_w).withColumnsRenamed({"y": "oy", "x": "ox"})
    sx = F.lit(float(x0)) + (F.col("ox") + 0.5) * ((x1 - x0) / out_w)
    sy = F.lit(float(y0)) + (F.col("oy") + 0.5) * ((y1 - y0) / out_h)
    src = pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    if not bilinear:
        taps = g.withColumns({"sx": F.floor(sx).cast("int"), "sy": F.floor(sy).cast("int")})
        return taps.join(src, ["sy", "sx"], "left").select("oy", "ox", F.coalesce("v", F.lit(0.0)).alias("v"))
    fx, fy = sx - 0.5, sy - 0.5
    t = g.withColumns({"_x": F.floor(fx).cast("int"), "_y": F.floor(fy).cast("int"), "_fx": fx - F.floor(fx), "_fy": fy - F.floor(fy)})
    taps = t.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j in (0, 1) for i in (0, 1)])))
    w = F.when(F.col("_d.dx") == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(F.col("_d.dy") == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    taps = taps.select("oy", "ox", (F.col("_x") + F.col("_d.dx")).alias("sx"), (F.col("_y") + F.col("_d.dy")).alias("sy"), w.alias("w"))
    return taps.join(src, ["sy", "sx"], "left").groupBy("oy", "ox").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))


def raster_block(pixels: DataFrame, by: int, bx: int, block: int, level: int = 0) -> DataFrame:
    """One block, missing pixels 0; the filter reaches the source, and prunes the files of a table that is laid out by lvl and by."""
    y0, x0 = by * block, bx * block
    if {"lvl", "by", "bx"} <= set(pixels.columns):
        pixels = pixels.where((F.col("lvl") == level) & (F.col("by") == by) & (F.col("bx") == bx))
    own = pixels.where((F.col("y") >= y0) & (F.col("y") < y0 + block) & (F.col("x") >= x0) & (F.col("x") < x0 + block))
    g = grid(pixels.sparkSession, block, block).select((F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"))
    return g.join(own.select("y", "x", "v"), ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def unproject(depth: DataFrame, inverse: list[float]) -> DataFrame:
    """(u, v, z) through an inverse projection, divided by w, z turned round."""
    r = [sum((F.col(c) * float(inverse[4 * i + k]) for k, c in enumerate(("u", "v", "z"))), F.lit(float(inverse[4 * i + 3]))) for i in range(4)]
    return depth.select("y", "x", (r[0] / r[3]).alias("px"), (r[1] / r[3]).alias("py"), (-r[2] / r[3]).alias("pz"))


def elevation(depth: DataFrame, width: int, height: int, frame: int = 4) -> DataFrame:
    """1 - depth, with a frame of zeros."""
    edge = (F.col("x") < frame) | (F.col("y") < frame) | (F.col("x") >= width - frame) | (F.col("y") >= height - frame)
    return depth.select("y", "x", F.when(edge, 0.0).otherwise(1.0 - F.col("v")).alias("v"))


def nested_spheres(spark, shells: int = 17, lat: int = 200, lon: int = 200, lo: int = 6, hi: int = 9) -> DataFrame:
    """Points of nested spheres; the shells lo..hi have value 1."""
    n = spark.range(shells * lat * lon).select(F.expr(f"cast(id div {lat * lon} as int)").alias("s"), F.expr(f"cast(id div {lon} % {lat} as int)").alias("i"), F.expr(f"cast(id % {lon} as int)").alias("j"))
    r = F.col("s") / float(2 * shells)
    th, ph = F.col("i") * (np.pi / lat), F.col("j") * (2 * np.pi / lon)
    return n.select("s", "i", "j", (0.5 + r * F.sin(th) * F.cos(ph)).alias("x"), (0.5 + r * F.sin(th) * F.sin(ph)).alias("y"), (0.5 + r * F.cos(th)).alias("z"), F.when(F.col("s").between(lo, hi), 1.0).otherwise(0.0).alias("val"))


def slab_lattice(spark, n: int = 64) -> DataFrame:
    """A lattice of n^3 points, 0 in the three slabs of half width 0.2 about the middle and 1 elsewhere."""
    i = spark.range(n**3).select(F.expr(f"cast(id % {n} as int)").alias("j"), F.expr(f"cast(id div {n} % {n} as int)").alias("i"), F.expr(f"cast(id div {n * n} as int)").alias("h"))
    at = {a: F.lit(1.0 / n) + F.col(c) / float(n + 3) for a, c in (("x", "i"), ("y", "j"), ("z", "h"))}
    p = i.select(*[e.alias(a) for a, e in at.items()])
    inside = (F.abs(F.col("x") - 0.5) < 0.2) | (F.abs(F.col("y") - 0.5) < 0.2) | (F.abs(F.col("z") - 0.5) < 0.2)
    return p.withColumn("val", F.when(inside, 0.0).otherwise(1.0))


def shell_points(candidates: DataFrame, least: float = 0.3, edge: float = 0.5) -> DataFrame:
    """Points of the unit cube scaled to ``edge``, of which those at least ``least`` from the origin stay (rejection), with value 1."""
    p = candidates.select(*[(F.col(a) * edge).alias(a) for a in AXES])
    return p.where(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) >= least).withColumn("val", F.lit(1.0))


def plateau(spark, n: int = 64, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """A terrain of two plateaus bounded by half planes."""
    g = grid(spark, n, n).select((F.col("x") / float(n)).alias("x"), (F.col("y") / float(n)).alias("y"))
    z = F.when((F.col("x") + F.col("y") > 0.75) & (F.col("x") - F.col("y") < 0.25) & (F.col("y") < 0.75), 0.5).when((F.col("x") > 0.75) & (F.col("y") > 0.5), 0.25).otherwise(0.0)
    return g.withColumn("z", z + F.randn(seed) * noise if noise else z)
