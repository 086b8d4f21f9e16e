"""Images as tables (y, x, v[, w]): stencils, pyramids, hole filling, occlusion, correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bricks


def shifted(image: DataFrame, deltas: list[tuple[int, int]], cols: tuple[str, ...] = ("v",)) -> DataFrame:
    """Every pixel handed to the pixels at these offsets from it: (y, x, dy, dx, cols), dy and dx being the source's place seen from the target."""
    d = F.explode(F.array(*[F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j, i in deltas]))
    s = image.select("y", "x", *cols).withColumn("_d", d)
    return s.select((F.col("y") - F.col("_d.dy")).alias("y"), (F.col("x") - F.col("_d.dx")).alias("x"), F.col("_d.dy").alias("dy"), F.col("_d.dx").alias("dx"), *cols)


def sobel(image: DataFrame) -> DataFrame:
    """Gradient magnitude over 4; the first row and column are 0, the far border sees zeros."""
    s = shifted(image, [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    weight = F.when(F.col("dx") == 0, 2.0).otherwise(1.0)
    weight_x = F.when(F.col("dy") == 0, 2.0).otherwise(1.0)
    g = s.groupBy("y", "x").agg(F.sum(-F.col("dx") * weight_x * F.col("v")).alias("gx"), F.sum(-F.col("dy") * weight * F.col("v")).alias("gy"))
    mag = F.sqrt((F.col("gx") / 4) ** 2 + (F.col("gy") / 4) ** 2)
    return image.select("y", "x").join(g, ["y", "x"]).select("y", "x", F.when((F.col("y") == 0) | (F.col("x") == 0), 0.0).otherwise(mag).alias("v"))


#: edge of the squares that stencils of images take
EDGE = 128


def median(image: DataFrame, k: int = 5) -> DataFrame:
    """Median of the neighbours inside the image; by squares with halos, each pixel in little over one."""

    def kernel(around):
        n = (~np.isnan(around)).sum(1)
        row, s = np.arange(len(around)), np.sort(around, 1)  # what isn't there comes last
        return {"v": (s[row, (n - 1) // 2] + s[row, n // 2]) / 2}

    return bricks.neighbourhoods(image, ["y", "x"], "v", k // 2, kernel, "v double", fill=np.nan, edge=EDGE)


def _tap(c: Column) -> Column:
    return F.when((c == 0) | (c == 1), 3.0).otherwise(1.0)


def push(image: DataFrame, last: bool = False, mode: str = "cuda") -> DataFrame:
    """Next coarser level (y, x, v, w) of a power-of-two image: 16 taps, normalised by weight.

    Each pixel names the two coarse rows and columns it counts in, so the taps meet in one grouping.
    """
    two = lambda c: F.array(F.floor(c / 2), F.floor(c / 2) + F.when(c % 2 == 1, 1).otherwise(-1))
    s = image.select("y", "x", "v", "w").withColumn("ty", F.explode(two(F.col("y")))).withColumn("tx", F.explode(two(F.col("x"))))
    k = _tap(F.col("y") - 2 * F.col("ty")) * _tap(F.col("x") - 2 * F.col("tx")) / 64.0 * (6.0 if mode == "shader" else 1.0)
    size = image.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("wd"))
    s = s.crossJoin(F.broadcast(size)).where("ty >= 0 and tx >= 0 and ty < h div 2 and tx < wd div 2")
    g = s.groupBy(F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x")).agg(F.sum(F.col("v") * k).alias("a"), F.sum(F.col("w") * k).alias("b"))
    w = F.least(F.greatest("b", F.lit(1e-7)), F.lit(999.0))
    full = F.lit(1.0) - F.pow(F.lit(1.0) - F.least(w, F.lit(1.0)), F.lit(16.0))
    return g.select("y", "x", (F.col("a") / w * (F.lit(1.0) if last else full)).alias("v"), full.alias("w"))


def pull(fine: DataFrame, coarse: DataFrame, mode: str = "cuda") -> DataFrame:
    """A level filled from the coarser one where its weight is below 1."""
    s = shifted(coarse, [(j, i) for j in range(-1, 3) for i in range(-1, 3)], ("v",))
    k = _tap(F.col("dy")) * _tap(F.col("dx")) / 64.0
    g = s.groupBy("y", "x").agg(F.sum(F.col("v") * k).alias("b")).select(F.col("y").alias("_y"), F.col("x").alias("_x"), "b")
    j = fine.join(g, (F.shiftright(fine.y, 1) == F.col("_y")) & (F.shiftright(fine.x, 1) == F.col("_x")), "left")
    own = F.col("w") * F.col("v") if mode == "cuda" else F.col("v")
    return j.select("y", "x", ((F.lit(1.0) - F.col("w")) * F.coalesce("b", F.lit(0.0)) + own).alias("v"), "w")


def push_pull(image: DataFrame, levels: int = 4, mode: str = "cuda") -> DataFrame:
    """Holes filled from a pyramid of constant depth."""
    pyramid = [image]
    for _ in range(levels):
        pyramid.append(push(pyramid[-1], mode=mode))
    out = pyramid[-1]
    for level in reversed(pyramid[:-1]):
        out = pull(level, out, mode)
    return out.select("y", "x", "v")


def min_pyramid(image: DataFrame) -> DataFrame:
    """Of each 2x2 block the pixel of least z, with all of it; ties: the last in row order."""
    order = F.struct("z", -(F.col("y") % 2 * 2 + F.col("x") % 2))
    return image.groupBy(F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg(F.min_by(F.struct("px", "py", "z"), order).alias("p")).select("y", "x", "p.px", "p.py", "p.z")


def occlusion_walk(depth: DataFrame, slope: float = 0.001, steps: int = 7) -> DataFrame:
    """Directions (of four) in which a nearer pixel within ``steps`` rises above the slope; masked from 3 on.

    Dense rows and columns are windows; no join.
    """

    def rises(order: str):
        return lambda p: (p["v"] <= 0.99999) & (p["v"] >= 0.00001) & (F.col("v") - p["v"] > F.abs(p["o"] - F.col(order)) * slope)

    out, dirs = depth, []
    for name, part, order, back in (("r", "y", "x", False), ("l", "y", "x", True), ("d", "x", "y", False), ("u", "x", "y", True)):
        w = Window.partitionBy(part).orderBy(order)
        w = w.rowsBetween(-steps, -1) if back else w.rowsBetween(1, steps)
        seen = F.collect_list(F.struct(F.col(order).alias("o"), "v")).over(w)
        out = out.withColumn(f"_{name}", seen)
        dirs.append(F.exists(f"_{name}", rises(order)))
    n = sum((d.cast("int") for d in dirs[1:]), dirs[0].cast("int"))
    back = F.col("v") > 0.9999999
    return out.select("y", "x", F.when(back, 0).otherwise(n).alias("blocked"), (~back & (n >= 3)).alias("masked"))


def sector_occlusion(levels: dict[int, DataFrame], scale: float = 16.0, limit: float = 0.12) -> DataFrame:
    """F8: how open a point is in 8 sectors, over the pyramid levels that its depth calls for.

    ``levels`` holds images (y, x, px, py, z) by level; a sector's value is its least 1 - cos over the levels; masked if the mean is below the limit.
    """
    base = levels[0]
    most = F.floor(F.log2(F.lit(scale) / F.greatest("z", F.lit(1e-9))))
    src = base.select("y", "x", "px", "py", "z", F.least(F.greatest(most, F.lit(0)), F.lit(max(levels))).cast("int").alias("most"))
    ring = [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (j, i) != (0, 0)]
    parts = None
    for lv, image in levels.items():
        s = src.where(F.col("most") >= lv).withColumn("_d", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), F.lit(i).alias("i")) for k, (j, i) in enumerate(ring)])))
        s = s.withColumns({"_y": F.shiftright("y", lv) + F.col("_d.j"), "_x": F.shiftright("x", lv) + F.col("_d.i")})
        o = image.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("z").alias("qz"))
        j = s.join(o, ["_y", "_x"])
        d = [F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("qz") - F.col("z")]
        q = [F.col("qx"), F.col("qy"), F.col("qz")]
        norm = F.sqrt(sum((c * c for c in d[1:]), d[0] * d[0])) * F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
        occ = 1.0 + sum((a * b for a, b in zip(d[1:], q[1:], strict=True)), d[0] * q[0]) / norm
        j = j.select("y", "x", F.col("_d.k").alias("k"), F.when(norm > 0, occ).alias("occ"))
        parts = j if parts is None else parts.unionByName(j)
    sector = parts.where("occ is not null").groupBy("y", "x", "k").agg(F.min("occ").alias("occ"))
    return sector.groupBy("y", "x").agg(F.avg("occ").alias("open")).withColumn("masked", F.col("open") < limit)


def height_steps(image: DataFrame) -> DataFrame:
    """A pixel beside its four axis neighbours; null at the border."""
    r, c = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    return image.select("y", "x", "v", F.lead("v").over(r).alias("xp"), F.lag("v").over(r).alias("xm"), F.lead("v").over(c).alias("yp"), F.lag("v").over(c).alias("ym"))


def patch_window(image: DataFrame, width: int, height: int, step: int = 256, overlap: int = 64, taper: int = 32, flip: bool = False) -> DataFrame:
    """pixels dealt into overlapping patches, tapered at the image's border and windowed by sin^2, on a pitch of twice the patch."""
    full = step + 2 * overlap
    nh, nw = -(-height // step), -(-width // step)
    back = (full - 1) // step  # patches before a pixel's own one that reach it

    def owners(c: str, n: int):
        q = F.floor(F.col(c) / step).cast("int")
        return F.explode(F.filter(F.sequence(F.greatest(q - back, F.lit(0)), F.least(q, F.lit(n - 1))), lambda k: F.col(c) - k * step < full))

    p = image.select("y", "x", "v").withColumn("qy", owners("y", nh)).withColumn("qx", owners("x", nw))
    ly, lx = F.col("y") - F.col("qy") * step, F.col("x") - F.col("qx") * step
    edge = lambda c, n: F.least(F.lit(1.0), F.least(F.col(c), F.lit(n) - F.col(c)) / float(taper))
    ham = lambda c: F.pow(F.sin(F.lit(float(np.pi)) * c / float(full)), F.lit(2.0))
    pitch, pad = 2 * full, full // 2
    at = lambda c: (F.lit(pitch - 1) - (c + pad)) if flip else c + pad
    return p.select("qy", "qx", at(ly).cast("int").alias("py"), at(lx).cast("int").alias("px"), (F.col("v") * edge("x", width) * edge("y", height) * ham(lx) * ham(ly)).alias("v"))


def fft_shift(image: DataFrame, width: int, height: int) -> DataFrame:
    """the origin moved to the middle."""
    return image.select(F.pmod(F.col("y") + height // 2, F.lit(height)).alias("y"), F.pmod(F.col("x") + width // 2, F.lit(width)).alias("x"), "v")


def peaks(images: DataFrame, key: list[str], width: int, height: int) -> DataFrame:
    """Each image's highest value (ties: the first in row order) and its offset from the middle."""
    best = F.max(F.struct("v", (-(F.col("y") * width + F.col("x"))).alias("i"))).alias("b")
    b = images.groupBy(*key).agg(best)
    i = -F.col("b.i")
    return b.select(*key, (i % width - width // 2).cast("int").alias("dx"), (F.floor(i / width) - height // 2).cast("int").alias("dy"), F.col("b.v").alias("peak"))


def correlate(a: DataFrame, b: DataFrame, pitch: int) -> DataFrame:
    """Circular convolution of equal patches of two images (flip one for correlation), as rows (qy, qx, y, x, v) with the origin in the middle.

    A patch is a dense pitch x pitch array of its own, so one group holds one patch.
    """

    def one(key, left, right):
        f = []
        for t in (left, right):
            m = np.zeros((pitch, pitch))
            m[t.column("py").to_numpy(), t.column("px").to_numpy()] = t.column("v").to_numpy()
            f.append(np.fft.rfft2(m))
        c = np.fft.fftshift(np.fft.irfft2(f[0] * f[1], s=(pitch, pitch)))
        y, x = np.divmod(np.arange(pitch * pitch, dtype=np.int32), pitch)
        n = len(y)
        return pa.table({"qy": pa.array(np.full(n, key[0].as_py(), np.int32)), "qx": pa.array(np.full(n, key[1].as_py(), np.int32)), "y": pa.array(y), "x": pa.array(x), "v": pa.array(c.ravel())})

    return a.groupBy("qy", "qx").cogroup(b.groupBy("qy", "qx")).applyInArrow(one, "qy int, qx int, y int, x int, v double")


def align(first: DataFrame, second: DataFrame, width: int, height: int, step: int = 256, overlap: int = 64, gradients: bool = True) -> DataFrame:
    """Offset of each patch of the second image against the first: (qy, qx, dx, dy, peak); equal peaks: the first offset in row order."""
    if gradients:
        first, second = sobel(first), sobel(second)
    full = step + 2 * overlap
    pitch = 2 * full
    a = patch_window(first, width, height, step, overlap)
    b = patch_window(second, width, height, step, overlap, flip=True)
    # the flip turns pixel i into pitch - 1 - i: without a shift the peak lies one before the origin
    c = correlate(a, b, pitch).withColumns({k: F.pmod(F.col(k) + 1, F.lit(pitch)) for k in ("y", "x")})
    # only offsets between pixels of both patches, of which those at the far border are cut: without gradients all sums are equal
    real = lambda k, q, n: F.abs(F.col(k) - full) < F.least(F.lit(full), F.lit(n) - F.col(q) * step)
    return peaks(c.where(real("y", "qy", height) & real("x", "qx", width)), ["qy", "qx"], pitch, pitch)
