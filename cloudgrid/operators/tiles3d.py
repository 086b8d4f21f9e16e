"""Tile trees (tile_id, parent_id, geo_error, refine, bv, xform): inheritance, distances, screen errors, what to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..functions.scalar import matmul4, screen_error, transform3

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
TOLERANCE = 10.0


def inherit(tiles: DataFrame) -> DataFrame:
    """Transforms multiplied down the tree, and refine and geo_error taken from the parent where they are null; one join a level,
    however many there are (tiles that no root leads to are left out)."""
    level = tiles.where("parent_id is null").withColumns({"depth": F.lit(0), "xform": F.coalesce("xform", F.array(*map(F.lit, IDENTITY))), "refine": F.coalesce("refine", F.lit("ADD")), "geo_error": F.coalesce("geo_error", F.lit(0.0))})
    level = settle(level)
    out, kids, d = level, tiles.where("parent_id is not null"), 0
    while True:
        d += 1
        up = level.select(F.col("tile_id").alias("parent_id"), F.col("xform").alias("_x"), F.col("refine").alias("_r"), F.col("geo_error").alias("_g"))
        level = kids.join(up, "parent_id").withColumns({"depth": F.lit(d), "xform": F.when(F.col("xform").isNull(), F.col("_x")).otherwise(matmul4(F.col("_x"), F.col("xform"))), "refine": F.coalesce("refine", "_r"), "geo_error": F.coalesce("geo_error", "_g")}).drop("_x", "_r", "_g").select(*out.columns)
        level = settle(level)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if d % 16 == 0:
            out = settle(out)


def move_volume(kind: Column, vals: Column, xform: Column) -> Column:
    """A sphere's centre or a box's four points through a transform; radii stay, regions stay."""
    at = lambda i: F.array(*[F.element_at(vals, i + k) for k in (1, 2, 3)])
    sphere = F.concat(transform3(xform, at(0)), F.array(F.element_at(vals, 4)))
    box = F.concat(*[transform3(xform, at(3 * i)) for i in range(4)])
    return F.when(kind == "sphere", sphere).when(kind == "box", box).otherwise(vals)


def distance(kind: Column, vals: Column, eye: tuple[float | Column, float | Column, float | Column]) -> Column:
    """From the eye (numbers, or columns of a camera path) to the centre of a sphere or box; 1 for regions."""
    at = [e if isinstance(e, Column) else F.lit(float(e)) for e in eye]
    d = F.sqrt(sum(((F.element_at(vals, k + 2) - at[k + 1]) ** 2 for k in range(2)), (F.element_at(vals, 1) - at[0]) ** 2))
    return F.when(kind == "region", 1.0).otherwise(d)


def with_error(tiles: DataFrame, eye: tuple[float, float, float], height: float, u: float) -> DataFrame:
    """K2: distance and screen-space error of every tile."""
    return tiles.withColumn("dist", distance(F.col("bv.type"), F.col("bv.vals"), eye)).withColumn("sse", screen_error(F.col("dist"), F.col("geo_error"), height, u))


def visited(tiles: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The steady state: a root is visited, and a child if its visited parent's error reaches the tolerance; to any depth."""
    tiles = settle(tiles)
    level = tiles.where("parent_id is null")
    out, d = level, 0
    while True:
        d += 1
        opened = level.where(F.col("sse") >= tolerance).select(F.col("tile_id").alias("parent_id"))
        level = settle(tiles.join(opened, "parent_id").select(*tiles.columns))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if d % 16 == 0:
            out = settle(out)


#: roots that are told to all tasks at most; more are joined
ROOTS = 100_000


def along(tiles: DataFrame, frames: DataFrame, height: float, u: float, tolerance: float = TOLERANCE) -> DataFrame:
    """K3 over a camera path: (tileset, frame, tile_id, depth, open) of the tiles that are open or on the frontier in each frame; all others are closed.

    In a frame, a tile opens its children where its error reaches the tolerance, and closes all below it where it doesn't; only tiles whose
    parent was open before are looked at, so a tree opens by one level a frame.  Hence a tile is open if its error reaches the tolerance
    and its parent is open in this frame and was in the one before, and the tree is gone down once, for all frames together: a join by parent
    and one by (tile, frame) a level, over no more than the tiles that are looked at.  A root, once open, stays on the frontier.
    ``tiles``: tileset, tile_id, parent_id, depth, geo_error, bv; ``frames``: tileset, frame (0, 1, 2.. without gaps), ex, ey, ez.
    """
    tiles, frames = settle(tiles), settle(frames)
    opens = screen_error(distance(F.col("bv.type"), F.col("bv.vals"), (F.col("ex"), F.col("ey"), F.col("ez"))), F.col("geo_error"), height, u) >= tolerance
    roots = tiles.where("parent_id is null")
    small = roots.limit(ROOTS + 1).count() <= ROOTS
    out = ["tileset", "frame", "tile_id", "depth", "ex", "ey", "ez", "open"]
    level = settle(frames.join(F.broadcast(roots) if small else roots, "tileset").withColumn("open", opens).select(*out))
    first = level.where("open").groupBy("tileset", "tile_id").agg(F.min("frame").alias("_first"))
    states = level.join(first, ["tileset", "tile_id"]).where(F.col("frame") >= F.col("_first")).select(*out)
    d = 0
    while True:
        d += 1
        now = level.where("open").select("tileset", "frame", F.col("tile_id").alias("parent_id"), "ex", "ey", "ez")
        before = now.select("tileset", (F.col("frame") + 1).alias("frame"), "parent_id", F.lit(True).alias("_was"))
        up = now.join(before, ["tileset", "frame", "parent_id"], "left")
        level = settle(tiles.join(up, ["tileset", "parent_id"]).withColumn("open", F.coalesce(F.col("_was"), F.lit(False)) & opens).select(*out))
        if level.isEmpty():
            return states.select("tileset", "frame", "tile_id", "depth", "open")
        states = states.unionByName(level)
        if d % 16 == 0:
            states = settle(states)


def transitions(states: DataFrame) -> DataFrame:
    """(tileset, frame, tile_id, opened): tiles that open in a frame, and those that were open in the one before and are no longer."""
    key = ["tileset", "frame", "tile_id"]
    last = states.groupBy("tileset").agg(F.max("frame").alias("_last"))
    now = states.where("open").select(*key, F.lit(True).alias("_now"))
    before = now.select("tileset", (F.col("frame") + 1).alias("frame"), "tile_id", F.lit(True).alias("_was"))
    both = now.join(before, key, "full").join(last, "tileset").where(F.col("frame") <= F.col("_last"))
    return both.where("_now is null or _was is null").select(*key, F.col("_now").isNotNull().alias("opened"))


def drawn(seen: DataFrame) -> DataFrame:
    """ADD tiles always, REPLACE tiles without a visited child."""
    parents = seen.where("parent_id is not null").select(F.col("parent_id").alias("tile_id")).distinct()
    return seen.where("refine = 'ADD'").unionByName(seen.where("refine <> 'ADD'").join(parents, "tile_id", "left_anti").select(*seen.columns))
