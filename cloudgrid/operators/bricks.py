"""Neighbourhoods by bricks with halos.

Cells are dealt into cubes (squares, for images) of ``edge`` cells; a cell within ``r`` of a border goes to the bricks beside it as well, so
each brick sees all neighbours of its own cells and one shuffle replaces a row for each neighbour: with an edge of 16 and r = 2 under two
rows a cell, where a scatter makes 125.  Tasks take their bricks in order of key, a bounded number at a time, as dense arrays.
A cell is one row, so a brick holds at most (edge + 2r)^3 rows however unevenly points lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = 16
#: cells of dense arrays that a step holds at once
ROOM = 1 << 20
#: bricks are numbered from -2^20 along an axis
_BIAS, _BITS = 1 << 20, 21


def deal(cells: DataFrame, axes: list[str], r: int, edge: int = EDGE) -> DataFrame:
    """Rows of cells, one for each brick that sees them: ``_b`` (the brick's key) and the place in it, ``_i`` (by axis, 0 being r cells before the brick)."""
    beside = (r + edge - 1) // edge  # bricks that a halo reaches

    def seen_by(a: str):
        brick = F.floor(F.col(a) / edge).cast("long")
        at = F.col(a) - brick * edge
        near = F.filter(F.array(*[F.lit(k).cast("long") for k in range(-beside, beside + 1)]), lambda k: (at - k * edge >= -r) & (at - k * edge < edge + r))
        return F.explode(F.transform(near, lambda k: brick + k))

    out = cells
    for a in axes:
        out = out.withColumn(f"_k{a}", seen_by(a))
    key, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    for a in axes:
        key = F.shiftleft(key, _BITS).bitwiseOR(F.col(f"_k{a}") + _BIAS)
        place = place * (edge + 2 * r) + (F.col(a) - F.col(f"_k{a}") * edge + r)
    return out.select(key.alias("_b"), place.cast("int").alias("_i"), *cells.columns).drop(*axes)


def corner(keys: np.ndarray, n: int, edge: int) -> list[np.ndarray]:
    """First cells of bricks, by axis."""
    return [((keys >> np.int64(_BITS * (n - 1 - k)) & np.int64((1 << _BITS) - 1)) - _BIAS) * edge for k in range(n)]


def by_key(rows: DataFrame, step: Callable[[pa.Table], pa.Table | None], schema: str, most: int = 1 << 16) -> DataFrame:
    """``step`` over whole runs of rows of one ``_b``, several at a time: at most about ``most`` rows, or one run."""

    def whole(table: pa.Table):
        key = table.column("_b").to_numpy()
        if not len(key):
            return
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        at = 0
        while at < len(key):
            k = max(int(np.searchsorted(ends, at + most, side="right")) - 1, int(np.searchsorted(ends, at, side="right")))
            out = step(table.slice(at, int(ends[k]) - at).combine_chunks())
            at = int(ends[k])
            if out is not None and out.num_rows:
                yield from out.to_batches()

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("_b").to_numpy()
            last = int(np.searchsorted(key, key[-1], side="left"))  # the last run may go on in the next batch
            if last and size + last >= most:
                yield from whole(pa.Table.from_batches([*held, b.slice(0, last)]))
                held, size = [b.slice(last)], b.num_rows - last
            else:
                held.append(b)
                size += b.num_rows
        if held:
            yield from whole(pa.Table.from_batches(held))

    return rows.repartition("_b").sortWithinPartitions("_b").mapInArrow(run, schema)


def neighbourhoods(cells: DataFrame, axes: list[str], value: str, r: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, fill: float = 0.0, edge: int = EDGE, flat: str | None = None) -> DataFrame:
    """``kernel`` over (cells, (2r + 1)^axes) arrays of the values around cells, ``fill`` where there is no cell; (axes, what it returns by name).

    Offsets run from -r to r, the last axis fastest.  An axis named ``flat`` has offset 0 only.  Cells are unique; a null value is taken as ``fill``.
    """
    n, wide = len(axes), edge + 2 * r
    volume = wide**n
    steps = np.array([wide ** (n - 1 - k) for k in range(n)])
    reach = [np.arange(1) if a == flat else np.arange(-r, r + 1) for a in axes]
    around = sum(g.ravel() * s for g, s in zip(np.meshgrid(*reach, indexing="ij"), steps, strict=True))
    group = max(1, ROOM // volume)

    def step(table):
        key, at = table.column("_b").to_numpy(), table.column("_i").to_numpy()
        v = table.column("_v").to_numpy()
        v = np.where(np.isnan(v), fill, v)
        bricks, brick = np.unique(key, return_inverse=True)
        place = [at // s % wide for s in steps]
        own = np.logical_and.reduce([(p >= r) & (p < r + edge) for p in place])
        made = []
        for first in range(0, len(bricks), group):
            inside = (brick >= first) & (brick < first + group)
            dense = np.full(min(group, len(bricks) - first) * volume, fill)
            dense[(brick[inside] - first) * volume + at[inside]] = v[inside]
            mine = np.flatnonzero(inside & own)
            for part in np.array_split(mine, -(-len(mine) * len(around) // ROOM) or 1):
                if len(part):
                    base = corner(bricks, n, edge)
                    spot = [pa.array((base[k][brick[part]] + place[k][part] - r).astype(np.int32)) for k in range(n)]
                    got = kernel(dense[((brick[part] - first) * volume + at[part])[:, None] + around])
                    made.append(pa.table([*spot, *[x if isinstance(x, pa.Array) else pa.array(x) for x in got.values()]], [*axes, *got]))
        return pa.concat_tables(made) if made else None

    rows = deal(cells.select(*axes, F.col(value).cast("double").alias("_v")), axes, r, edge)
    return by_key(rows, step, ", ".join(f"{a} int" for a in axes) + ", " + schema)


def offsets(n: int, r: int) -> np.ndarray:
    """The offsets of a kernel's columns, a row for each axis."""
    return np.stack([g.ravel() for g in np.meshgrid(*[np.arange(-r, r + 1)] * n, indexing="ij")])
