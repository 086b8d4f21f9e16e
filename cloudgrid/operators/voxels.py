"""Voxels and sparse octrees as tables (lvl, x, y, z, ...): sums, neighbourhoods, balance, density, normals, visibility."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.lineage import settle
from ..functions.scalar import cell, morton
from . import bricks

CELL = ["x", "y", "z"]
#: value of cells that are only structure
STRUCTURE = 1e-9


def offsets(r: int, flat: bool = False) -> F.Column:
    """Array of all offsets of a cube of edge 2r + 1; flat: of its middle layer."""
    return F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for k in ([0] if flat else range(-r, r + 1)) for j in range(-r, r + 1) for i in range(-r, r + 1)])


def bin_points(points: DataFrame, level: int) -> DataFrame:
    """Voxel indices of points of the unit cube."""
    size = 1 << level
    p = points.where(" and ".join(f"{a} >= 0 and {a} < 1" for a in CELL))
    return p.withColumns({f"v{a}": cell(F.col(a), size) for a in CELL})


def voxelize(points: DataFrame, level: int, value: str | None = None, reduce: str = "sum") -> DataFrame:
    """(x, y, z, n, val) of one level; partial sums first, no sort."""
    v = F.lit(1.0) if value is None else F.col(value)
    b = bin_points(points, level).select(*[F.col(f"v{a}").alias(a) for a in CELL], v.alias("_v"))
    return b.groupBy(*CELL).agg(F.count("*").alias("n"), getattr(F, reduce)("_v").alias("val"))


def coarser(voxels: DataFrame, by: int = 1, sums: tuple[str, ...] = ("n", "val")) -> DataFrame:
    """The level above, from the level below (sums are associative)."""
    return voxels.groupBy(*[F.shiftright(a, by).alias(a) for a in CELL]).agg(*[F.sum(s).alias(s) for s in sums])


#: levels that one sorted pass rolls up: a group of it holds 8^SPAN cells at most, so none is hot
SPAN = 5


def by_prefix(cells: DataFrame, span: int) -> DataFrame:
    """Cells with ``_m``, their Morton key, and its prefixes ``_m1`` to ``_m<span>`` of 1 to ``span`` levels above, dealt to tasks by the last: whatever is grouped by any of them needs no further shuffle."""
    keyed = cells.withColumn("_m", morton("x", "y", "z"))
    return keyed.withColumns({f"_m{i}": F.shiftright("_m", 3 * i) for i in range(1, span + 1)}).repartition(f"_m{span}")


def _inside(i: int, span: int):
    """Window of the cells below one prefix; all of them share one sort, as each one's order begins with the next one's."""
    return Window.partitionBy(*[f"_m{k}" for k in range(span, i - 1, -1)])


def _rolled(cells: DataFrame, depth: int, top: int, sums: tuple[str, ...]) -> DataFrame:
    """The levels depth to top of a tree from its finest cells, by one shuffle: the first cell of each prefix stands for it, with the sum over it."""
    span = depth - top
    if not span:
        return cells.select(F.lit(depth).alias("lvl"), *CELL, *sums)
    out, order = by_prefix(cells, span), [f"_m{k}" for k in range(span, 0, -1)]
    first = Window.partitionBy(f"_m{span}").orderBy(*order[1:], "_m")
    out = out.withColumns({f"_p{i}": F.lag(f"_m{i}").over(first) for i in range(1, span + 1)})
    for i in range(1, span + 1):
        out = out.withColumns({f"_{c}{i}": F.sum(c).over(_inside(i, span)) for c in sums})
    level = lambda i: F.struct(F.lit(depth - i).alias("lvl"), *[F.shiftright(a, i).alias(a) for a in CELL], *[F.col(f"_{c}{i}" if i else c).alias(c) for c in sums])
    begins = [level(0), *[F.when(F.col(f"_p{i}").isNull() | (F.col(f"_p{i}") != F.col(f"_m{i}")), level(i)) for i in range(1, span + 1)]]
    return out.select(F.explode(F.filter(F.array(*begins), lambda e: e.isNotNull())).alias("_e")).select("_e.*")


def roll_up(cells: DataFrame, depth: int, least: int, sums: tuple[str, ...] = ("n", "val")) -> DataFrame:
    """(lvl, x, y, z, sums) of all levels from depth down to least.

    ``SPAN`` levels at a time come from one shuffle by Morton prefix; where there are more, each block is a table, from whose coarsest level the next one is made.
    """
    out = None
    while True:
        top = max(least, depth - SPAN)
        block = _rolled(cells, depth, top, sums)
        if top > least:
            block = settle(block)
            cells = block.where(F.col("lvl") == top).drop("lvl")
            block = block.where(F.col("lvl") > top)
        out = block if out is None else out.unionByName(block)
        if top == least:
            return out
        depth = top


def octree(points: DataFrame, depth: int, least: int, value: str | None = None) -> DataFrame:
    """All levels from depth down to least; points are read and shuffled once, as partial sums of the finest cells."""
    return roll_up(voxelize(points, depth, value), depth, least)


def level_stats(tree: DataFrame) -> DataFrame:
    """Sizes, offsets (finest first) and the share of the finer level's cells."""
    n = tree.groupBy("lvl").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("lvl"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("lvl", "n", before.alias("start"), (F.col("n") / F.lag("n").over(w)).alias("retain"))


def near_cells(cells: DataFrame, deltas: list[tuple[int, int, int]]) -> DataFrame:
    """Cells at the offsets from the given ones, each once (a scatter, so the semi-join needs one probe)."""
    d = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(CELL, t, strict=True)]) for t in deltas]))
    return cells.withColumn("_d", d).select(*[(F.col(a) + F.col(f"_d.d{a}")).alias(a) for a in CELL]).distinct()


def filter_outliers(points: DataFrame, level: int = 7, least: int = 6) -> DataFrame:
    """Points with a cell of ``least`` points among the 3x3 cells around theirs at the same height."""
    good = voxelize(points, level).where(F.col("n") >= least).select(*CELL)
    near = near_cells(good, [(i, j, 0) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    near = near.select(*[F.col(a).alias(f"v{a}") for a in CELL])
    return bin_points(points, level).join(near, ["vx", "vy", "vz"], "left_semi").drop("vx", "vy", "vz")


def density(points: DataFrame, level: int, levels: int = 6) -> DataFrame:
    """Own count plus 2^-i of the count of each ancestor i: sums over the prefixes of one sorted pass, no join.

    Ancestors beyond ``SPAN`` levels up are joined from a table of the coarser levels.
    """
    v = voxelize(points, level).select(*CELL, "n")
    span = min(levels - 1, SPAN)
    if not span:
        return v.withColumn("density", F.col("n").cast("double"))
    if levels - 1 > span:
        v = settle(v)
    near = F.col("n").cast("double")
    out = by_prefix(v, span)
    for i in range(1, span + 1):
        out = out.withColumn(f"_n{i}", F.sum("n").over(_inside(i, span)))
        near = near + F.col(f"_n{i}") * 0.5**i
    out = out.select(*CELL, "n", near.alias("density"))
    for i in range(span + 1, levels):
        up = coarser(v, by=i, sums=("n",)).select(*[F.col(a).alias(f"_{a}") for a in CELL], F.col("n").alias("_n"))
        out = out.join(up, [F.shiftright(a, i) == F.col(f"_{a}") for a in CELL]).withColumn("density", F.col("density") + F.col("_n") * 0.5**i).drop("_x", "_y", "_z", "_n")
    return out


def heightmap(points: DataFrame, width: int, height: int | None = None, dense: bool = True) -> DataFrame:
    """Highest z of each pixel with weight 1; empty pixels have 0 and 0."""
    from .points import grid

    h = height or width
    at = lambda v, n: F.least(F.greatest(F.floor(v * float(n) + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    top = points.groupBy(at(F.col("y"), h).alias("y"), at(F.col("x"), width).alias("x")).agg(F.max("z").alias("v"))
    if not dense:
        return top.withColumn("w", F.lit(1.0))
    g = grid(points.sparkSession, h, width)
    return g.join(top, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"), F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0).alias("w"))


def neighbours(voxels: DataFrame, r: int = 1, flat: bool = False) -> DataFrame:
    """Each cell's existing neighbours (itself too): cell, offset, the neighbour's val."""
    d = voxels.select(*CELL).withColumn("_d", F.explode(offsets(r, flat)))
    at = d.select(*CELL, F.col("_d.dx").alias("dx"), F.col("_d.dy").alias("dy"), F.col("_d.dz").alias("dz"), *[(F.col(a) + F.col(f"_d.d{a}")).alias(f"n{a}") for a in CELL])
    return at.join(voxels.select(*[F.col(a).alias(f"n{a}") for a in CELL], F.col("val").alias("nval")), ["nx", "ny", "nz"])


def neighbour_sums(voxels: DataFrame, r: int = 1) -> DataFrame:
    """(x, y, z, k, total): how many cells there are about each (itself too), and their values; by bricks."""

    def kernel(around):
        there = ~np.isnan(around)
        return {"k": there.sum(1), "total": np.where(there, around, 0.0).sum(1)}

    return bricks.neighbourhoods(voxels, CELL, "val", r, kernel, "k long, total double", fill=np.nan)


def child_parents(fine: DataFrame) -> DataFrame:
    return fine.select(*[F.shiftright(a, 1).alias(a) for a in CELL]).distinct()


def with_children(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Coarse cells that have a child."""
    return coarse.join(child_parents(fine), CELL, "left_semi")


def leaves(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Coarse cells without a child."""
    return coarse.join(child_parents(fine), CELL, "left_anti")


def missing_neighbours(coarse: DataFrame, fine: DataFrame, size: int) -> DataFrame:
    """Cells that a fine cell needs beside its parent for a step of one level at most: the three on its side, and the corner one where its three sides agree."""
    side = {a: F.col(a).bitwiseAND(F.lit(1)) * 2 - 1 for a in CELL}
    p = fine.select(*[F.shiftright(a, 1).alias(a) for a in CELL], *[side[a].alias(f"s{a}") for a in CELL]).distinct()
    cand = [F.struct(*[(F.col(a) + (F.col(f"s{a}") if a == axis else 0)).alias(a) for a in CELL]) for axis in CELL]
    corner = F.when((F.col("sx") == F.col("sy")) & (F.col("sy") == F.col("sz")), F.struct(*[(F.col(a) + F.col(f"s{a}")).alias(a) for a in CELL]))
    c = p.select(F.explode(F.array(*cand, corner)).alias("c")).where("c is not null").select("c.*").distinct()
    c = c.where(" and ".join(f"{a} >= 0 and {a} < {size}" for a in CELL))
    return c.join(coarse.select(*CELL), CELL, "left_anti")


def sparse_add(cells: DataFrame, more: DataFrame, value: float = STRUCTURE) -> DataFrame:
    """Cells with further structural ones; equal cells add up."""
    return cells.select(*CELL, "val").unionByName(more.select(*CELL, F.lit(value).alias("val"))).groupBy(*CELL).agg(F.sum("val").alias("val"))


def balance(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """Levels keyed by depth, made so that neighbours differ by one level; from fine to coarse."""
    out = dict(levels)
    for d in sorted(out, reverse=True)[:-2]:
        out[d - 1] = sparse_add(out[d - 1], missing_neighbours(out[d - 1], out[d], 1 << (d - 1)))
    return out


def missing_siblings(fine: DataFrame) -> DataFrame:
    """Children that a parent with any child lacks."""
    eight = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for k in (0, 1) for j in (0, 1) for i in (0, 1)])
    all_ = child_parents(fine).withColumn("_d", F.explode(eight)).select(*[(F.col(a) * 2 + F.col(f"_d.{a}")).alias(a) for a in CELL])
    return all_.join(fine.select(*CELL), CELL, "left_anti")


def complete(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """Every parent with a child gets all eight, level by level from the coarsest."""
    out = dict(levels)
    for d in sorted(out)[1:]:
        out[d] = sparse_add(out[d], missing_siblings(out[d]))
    return out


def compress(levels: dict[int, DataFrame]) -> DataFrame:
    """All finest cells, and coarser cells without children."""
    order = sorted(levels, reverse=True)
    out = levels[order[0]].select(F.lit(order[0]).alias("lvl"), *CELL, "val")
    for fine, d in zip(order, order[1:], strict=False):
        out = out.unionByName(leaves(levels[d], levels[fine]).select(F.lit(d).alias("lvl"), *CELL, "val"))
    return out


def node_centres(cells: DataFrame, compressed: bool = False) -> DataFrame:
    """Positions in the unit cube of (lvl, x, y, z); compressed cells by their centre."""
    half = 0.5 if compressed else 0.0
    return cells.withColumns({f"p{a}": (F.col(a) + half) / F.call_function("shiftleft", F.lit(1), F.col("lvl")).cast("double") for a in CELL})


_SIX = (("xx", "dx", "dx"), ("yy", "dy", "dy"), ("zz", "dz", "dz"), ("xy", "dx", "dy"), ("xz", "dx", "dz"), ("yz", "dy", "dz"))


def covariances(voxels: DataFrame, r: int = 2) -> DataFrame:
    """Second moments of the neighbourhood (offsets weighted by value over squared length) and its support; by bricks."""
    d = dict(zip(("dx", "dy", "dz"), bricks.offsets(3, r), strict=True))
    l2 = np.maximum(sum(o * o for o in d.values()), 1).astype(float)
    names = [c for c, _, _ in _SIX] + ["support"]
    weights = np.stack([d[a] * d[b] / l2 for _, a, b in _SIX] + [np.ones(len(l2))], 1)
    kernel = lambda around: dict(zip(names, (around @ weights).T.copy(), strict=True))
    return bricks.neighbourhoods(voxels, CELL, "val", r, kernel, ", ".join(f"{c} double" for c in names))


def covariances_multilevel(voxels: DataFrame, levels: int = 3, support: float = 4.0) -> DataFrame:
    """Own sums plus those of ancestors by 4^-level, where they have support; supports add up."""
    tree = settle(roll_up(voxels.select(*CELL, "val"), levels - 1, 0, ("val",)))  # levels by their height above the coarsest one
    base, total = tree.where(F.col("lvl") == levels - 1).select(*CELL), None
    for i in range(levels):
        c = covariances(tree.where(F.col("lvl") == levels - 1 - i)).select(*[F.col(a).alias(f"_{a}") for a in CELL], *[F.when(F.col("support") > support, F.col(k) * 0.25**i).otherwise(0.0).alias(k) for k, _, _ in _SIX], "support")
        part = base.join(c, [F.shiftright(a, i) == F.col(f"_{a}") for a in CELL]).select(*CELL, *[k for k, _, _ in _SIX], "support")
        total = part if total is None else total.unionByName(part)
    return total.groupBy(*CELL).agg(*[F.sum(k).alias(k) for k, _, _ in _SIX], F.sum("support").alias("support"))


def layer_support(voxels: DataFrame, r: int = 2, least: float = 40.0) -> DataFrame:
    """(x, y, z, support): the value of the (2r+1)^2 cells about each at its height, null where that is ``least`` at most."""
    n = bricks.neighbourhoods(voxels, CELL, "val", r, lambda around: {"support": around.sum(1)}, "support double", flat="z")
    return n.select(*CELL, F.when(F.col("support") > least, F.col("support")).alias("support"))


@F.pandas_udf(ArrayType(DoubleType()))
def smallest_axis(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
    """L1: unit eigenvector of the smallest eigenvalue, its largest component positive; null where it is not determined."""
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float)
    ok = np.isfinite(m).all((1, 2))
    w, v = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
    n = v[:, :, 0]
    k = np.abs(n).argmax(1)
    n = n * np.where(n[np.arange(len(n)), k] < 0, -1.0, 1.0)[:, None]
    ok &= (w[:, 1] - w[:, 0]) > 1e-9 * np.maximum(w[:, 2], 1e-30)
    return pd.Series([x if good else None for x, good in zip(n, ok, strict=True)])


def normals(cov: DataFrame, support: float = 4.0) -> DataFrame:
    """Normals of cells with support, null elsewhere."""
    n = smallest_axis(*[F.col(k) for k, _, _ in _SIX])
    return cov.select(*CELL, F.when(F.col("support") > support, n).alias("normal"), "support")


def normals_multilevel(voxels: DataFrame, levels: int = 3) -> DataFrame:
    """L3: normals of ancestors added by 2^-level, scaled to length 1; null where nothing adds up."""
    tree = settle(roll_up(voxels.select(*CELL, "val"), levels - 1, 0, ("val",)))
    base, total = tree.where(F.col("lvl") == levels - 1).select(*CELL), None
    for i in range(levels):
        n = normals(covariances(tree.where(F.col("lvl") == levels - 1 - i))).where("normal is not null").select(*[F.col(a).alias(f"_{a}") for a in CELL], *[(F.element_at("normal", k + 1) * 0.5**i).alias(f"n{a}") for k, a in enumerate(CELL)])
        part = base.join(n, [F.shiftright(a, i) == F.col(f"_{a}") for a in CELL]).select(*CELL, "nx", "ny", "nz")
        total = part if total is None else total.unionByName(part)
    s = total.groupBy(*CELL).agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in CELL])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.select(*CELL, *[F.when(length > 0, F.col(f"n{a}") / length).alias(f"n{a}") for a in CELL])


#: directions of the rays of the sky mask: straight up, and four diagonals; a ray's cell at step p spans ``RISE`` heights from p * RISE
RAYS = ((0, 0), (-1, -1), (1, -1), (1, 1), (-1, 1))
STEPS, RISE = 20, 5


#: edge of the squares of columns that a step of the sky mask takes, and bits of a word of a column
COLUMNS, WORD = 64, 64


def _shifted(words: np.ndarray, by: int) -> np.ndarray:
    """Rows of words as long bit strings, moved down by ``by`` places."""
    skip, bits = divmod(by, WORD)
    out = np.zeros_like(words)
    if skip < words.shape[1]:
        out[:, : words.shape[1] - skip] = words[:, skip:] >> np.uint64(bits)
        if bits and skip + 1 < words.shape[1]:
            out[:, : words.shape[1] - skip - 1] |= words[:, skip + 1 :] << np.uint64(WORD - bits)
    return out


def visibility(voxels: DataFrame, rays=RAYS, steps: int = STEPS, rise: int = RISE) -> DataFrame:
    """Bit i of the mask falls if ray i meets a cell above.

    A column's heights are words of bits, made by one aggregation.  Squares of columns see the columns that rays reach beyond their
    borders (a column is in under four squares), and a step of a ray is one shift and one OR of whole columns, whatever they hold.
    """
    word = F.floor(F.col("z") / WORD).cast("int").alias("w")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("z"), F.lit(WORD)).cast("int"))
    columns = voxels.groupBy("x", "y", word).agg(F.bit_or(bit).alias("bits"))
    r = (steps - 1) * max([abs(d) for ray in rays for d in ray] or [0])
    edge = max(COLUMNS, r)
    wide = edge + 2 * r

    def one(key, at, w, bits):
        low = int(w.min())
        spots, row = np.unique(at, return_inverse=True)
        words = np.zeros((len(spots) + 1, int(w.max()) - low + 1), np.uint64)  # the last row is a column without cells
        words[row, w - low] = bits
        x, y = spots // wide, spots % wide
        mine = np.flatnonzero((x >= r) & (x < r + edge) & (y >= r) & (y < r + edge))
        where = np.full(wide * wide, len(spots))
        where[spots] = np.arange(len(spots))
        above = np.zeros_like(words)  # bit z: a cell among the heights z + 1 to z + rise - 1; with it, z as well
        for h in range(1, rise):
            above |= _shifted(words, h)
        run = words | above
        own = words[mine]
        # cells of the own columns: set bits, word by word
        c, k = np.nonzero(own)
        held = (own[c, k][:, None] >> np.arange(WORD, dtype=np.uint64) & np.uint64(1)).astype(bool)
        e, b = np.nonzero(held)
        c, k = c[e], k[e]
        mask = np.full(len(c), 255, np.int32)
        for i, (dx, dy) in enumerate(rays):
            hit = above[mine]
            for p in range(1, steps):
                hit |= _shifted(run[where[(x[mine] + dx * p) * wide + y[mine] + dy * p]], rise * p)
            mask -= ((hit[c, k] >> b.astype(np.uint64)) & np.uint64(1)).astype(np.int32) << i
        bx, by = bricks.corner(np.array([key]), 2, edge)
        out = [bx[0] + x[mine][c] - r, by[0] + y[mine][c] - r, (k + low) * WORD + b, mask]
        return pa.table([pa.array(o.astype(np.int32)) for o in out], [*CELL, "mask"])

    def step(table):
        key, at, w = (table.column(n).to_numpy() for n in ("_b", "_i", "w"))
        bits = table.column("bits").to_numpy().view(np.uint64)
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        return pa.concat_tables([one(key[s], at[s:e], w[s:e], bits[s:e]) for s, e in zip(starts, ends, strict=True)])

    return bricks.by_key(bricks.deal(columns, ["x", "y"], r, edge), step, "x int, y int, z int, mask int")


def combine_visibility(masks: dict[int, DataFrame]) -> DataFrame:
    """A finest cell's mask and those of its ancestors (keyed by levels above the finest)."""
    out = masks[0]
    for i in sorted(masks)[1:]:
        up = masks[i].select(*[F.col(a).alias(f"_{a}") for a in CELL], F.col("mask").alias("_m"))
        out = out.join(up, [F.shiftright(a, i) == F.col(f"_{a}") for a in CELL], "left").select(*CELL, F.col("mask").bitwiseAND(F.coalesce("_m", F.lit(255))).alias("mask"))
    return out
