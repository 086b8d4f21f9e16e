"""Points in the order of a space-filling curve, with the curve's ranges of every file: rectangles read little more than what they hold.

    store.write(points, path)                          # x, y and any other columns
    store.area(spark, path, 0.25, 0.125, 0.5, 0.75)

A point's key is its place on the curve over a grid of 2^BITS cells a side.  Files are ranges of keys, and row groups and pages within
them too, so a rectangle, split into few ranges of keys that cover it, prunes files by the table of ranges, and row groups and pages by
Parquet's own statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import interleaved

#: bits of an axis of the key's grid, and the most ranges that a rectangle is split into
BITS, RANGES = 24, 64
#: rows of a page, which is the least that is read
PAGE = 20_000
#: tasks that write, at most, as long as one's rows are no more than this
TASKS, TASK_ROWS = 256, 2_000_000


def _place(v: Column, low: float, high: float) -> Column:
    """A coordinate's cell; what lies outside the box, or isn't known, is in a border cell."""
    at = F.floor((v - low) / (high - low or 1.0) * float(1 << BITS)).cast("long")
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")


def _cell(v: float, low: float, high: float) -> int:
    return min(max(int((v - low) / (high - low or 1.0) * float(1 << BITS) // 1), 0), (1 << BITS) - 1)


def write(points: DataFrame, path: str, rows: int = 2_000_000, page: int = PAGE) -> None:
    """Writes points (x, y, ...) as files of about ``rows`` rows in the curve's order; those without a finite place are kept, and in no rectangle.

    Sorted by ranges of keys, with rows of one key spread over ranges too, so no place is one task's, however many points lie there.  Small
    files are several of one task, as each task's report and share of the ranges' sample come to the driver.
    """
    known = lambda a: F.when(~F.col(a).isin(*map(float, ("nan", "inf", "-inf"))), F.col(a).cast("double"))
    points.agg(F.count("*").alias("n"), *[F.coalesce(f(known(a)), F.lit(0.0)).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))]).write.parquet(f"{path}/box")
    b = points.sparkSession.read.parquet(f"{path}/box").first()
    if not b.n:
        points.withColumn("_m", F.lit(0).cast("long")).write.parquet(f"{path}/points")
        return
    key = interleaved(_place(F.col("x"), b.min_x, b.max_x), _place(F.col("y"), b.min_y, b.max_y))
    own = points.withColumn("_m", key).withColumn("_tie", F.monotonically_increasing_id())
    files, tasks = -(-b.n // rows), max(TASKS, -(-b.n // TASK_ROWS))
    own = own.repartitionByRange(min(files, tasks), "_m", "_tie").sortWithinPartitions("_m").drop("_tie")
    own.write.option("maxRecordsPerFile", 0 if files <= tasks else rows).option("parquet.page.row.count.limit", page).option("parquet.block.size", max(64 * page, 1 << 16)).parquet(f"{path}/points")
    kept = points.sparkSession.read.parquet(f"{path}/points").select("_m", F.col("_metadata.file_name").alias("file"))
    kept.groupBy("file").agg(F.min("_m").alias("low"), F.max("_m").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/ranges")


def curve_ranges(x0: int, y0: int, x1: int, y1: int, bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys (both ends included) that cover a rectangle of cells (both ends included).

    Squares that lie in part outside are quartered, the largest first, as long as there is room; neighbours on the curve are joined.
    """
    inside, partial, level = [], [(0, 0, 0)], bits  # (key's prefix, x, y) of squares of 2^level cells
    while partial and level and len(inside) + 4 * len(partial) <= 4 * most:
        level -= 1
        quarters = []
        for m, x, y in partial:
            for k in range(4):
                qx, qy = 2 * x + (k & 1), 2 * y + (k >> 1)
                left, low, right, top = qx << level, qy << level, ((qx + 1) << level) - 1, ((qy + 1) << level) - 1
                if right < x0 or left > x1 or top < y0 or low > y1:
                    continue
                whole = x0 <= left and right <= x1 and y0 <= low and top <= y1
                if whole:
                    inside.append((4 * m + k << 2 * level, (4 * m + k + 1 << 2 * level) - 1))
                else:
                    quarters.append((4 * m + k, qx, qy))
        partial = quarters
    spans = sorted(inside + [(m << 2 * level, (m + 1 << 2 * level) - 1) for m, _, _ in partial])
    joined: list[list[int]] = []
    for low, high in spans:
        if joined and low == joined[-1][1] + 1:
            joined[-1][1] = high
        else:
            joined.append([low, high])
    while len(joined) > most:  # the narrowest gap is read as well
        k = min(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
        joined[k - 1][1] = joined.pop(k)[1]
    return [(a, b) for a, b in joined]


def area(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The points of a closed rectangle, from the files, row groups and pages whose keys meet it."""
    b = spark.read.parquet(f"{path}/box").first()
    every = spark.read.parquet(f"{path}/points")
    if not b.n or x0 > x1 or y0 > y1:
        return every.limit(0).drop("_m")
    spans = curve_ranges(*[_cell(v, low, high) for v, low, high in ((x0, b.min_x, b.max_x), (y0, b.min_y, b.max_y), (x1, b.min_x, b.max_x), (y1, b.min_y, b.max_y))])

    def meets(low: str, high: str) -> Column:
        out = F.lit(False)
        for first, last in spans:
            out = out | ((F.col(high) >= first) & (F.col(low) <= last))
        return out

    files = [r.file for r in spark.read.parquet(f"{path}/ranges").where(meets("low", "high")).select("file").collect()]
    if not files:
        return every.limit(0).drop("_m")
    near = spark.read.schema(every.schema).parquet(*[f"{path}/points/{f}" for f in sorted(files)])
    return near.where(meets("_m", "_m")).where((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1)).drop("_m")


def tile(spark: SparkSession, path: str, tx: int, ty: int, edge: float) -> DataFrame:
    """The points of a tile's closed box."""
    return area(spark, path, tx * edge, ty * edge, (tx + 1) * edge, (ty + 1) * edge)
