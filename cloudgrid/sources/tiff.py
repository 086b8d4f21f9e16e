"""Python data source ``tiff``: the blocks of tiled or stripped TIFF files and of their overviews, each read by its byte range.

    tiff.scan(spark, folder).where("lvl = 1 and by = 3 and bx between 2 and 4")
    tiff.window(spark, path, x0, y0, x1, y1, 512, 512)

A file's directories are read once for the plan; blocks that the filters on lvl, by and bx leave are dealt to tasks, and only their bytes are
read (``scan`` turns spark.sql.python.filterPushdown.enabled on, which the source needs).  Samples: 8-bit, 16-bit and 32-bit float, as they are or
deflated, chunky.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .raster import directories
from .sink import place

SCHEMA = "path string, lvl int, by int, bx int, y int, x int, band int, v double"
LEVELS = "path string, lvl int, width int, height int, bands int, block_w int, block_h int, a double, b double, d double, f double"
#: Fixed values of the format: the sample's type by bits and sample format.
SAMPLES = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 3): "f4"}
#: pixels that a task's blocks hold, about
PIXELS = 1 << 22


class Tiff:
    """The levels of a file: sizes and where their blocks are."""

    def __init__(self, path: str):
        disk, at = place(path)
        with disk.open_input_file(at) as f:
            size = f.size()
            self.end, ifds = directories(lambda o, n: f.read_at(max(min(n, size - o), 0), o))
        self.path, self.levels = path, []
        sx, sy = ifds[0].get(33550, (1.0, 1.0, 0.0))[:2]
        i, j, _, x, y = ifds[0].get(33922, (0.0,) * 6)[:5]
        self.geo = (x - i * sx, sx, y + j * sy, -sy)
        for t in ifds:
            w, h, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
            kind = SAMPLES.get((t.get(258, (8,))[0], t.get(339, (1,))[0]))
            if kind is None or t.get(284, (1,))[0] != 1 or t.get(259, (1,))[0] not in (1, 8, 32946) or t.get(317, (1,))[0] not in (1, 2):
                raise ValueError(f"{path}: samples, planes or a compression that aren't read")
            tiled = 322 in t
            bw, bh = (t[322][0], t[323][0]) if tiled else (w, min(t.get(278, (h,))[0], h))
            spots = t[324] if tiled else t[273]
            self.levels.append({"w": w, "h": h, "bands": bands, "kind": self.end + kind, "bw": bw, "bh": bh, "tiled": tiled, "at": spots, "size": t[325] if tiled else t[279], "packed": t.get(259, (1,))[0] != 1, "differences": t.get(317, (1,))[0] == 2, "across": -(-w // bw)})

    def block(self, read, level: int, by: int, bx: int) -> np.ndarray:
        """(rows, columns, bands) of a block, without what lies beyond the border."""
        v = self.levels[level]
        k = by * v["across"] + bx
        raw = read(v["at"][k], v["size"][k])
        raw = zlib.decompress(raw) if v["packed"] else raw
        rows = v["bh"] if v["tiled"] else min(v["bh"], v["h"] - by * v["bh"])
        out = np.frombuffer(raw, v["kind"], rows * v["bw"] * v["bands"]).reshape(rows, v["bw"], v["bands"])
        if v["differences"]:
            out = np.cumsum(out, 1, dtype=out.dtype)
        return out[: v["h"] - by * v["bh"], : v["w"] - bx * v["bw"]]


class Blocks(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int, int]]):
        self.path, self.blocks = path, blocks


def files_of(path: str) -> list[str]:
    """The .tif and .tiff files of a folder, or the file."""
    disk, at = place(path)
    info = disk.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = disk.get_file_info(fs.FileSelector(at))
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(lead + f.path for f in found if f.type == fs.FileType.File and f.extension.lower() in ("tif", "tiff"))


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.levels_only = options["path"], str(options.get("levels", "false")).lower() == "true"
        self.low, self.high = {}, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the level, block row and block column choose blocks; Spark applies all filters again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("lvl", "by", "bx") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    last = f.value - isinstance(f, LessThan)
                    self.high[name] = min(self.high.get(name, last), last)
            yield f

    def _span(self, name: str, n: int) -> range:
        return range(self.low.get(name, 0), min(n, self.high.get(name, n) + 1))

    def partitions(self) -> list[Blocks]:
        paths = files_of(self.path)
        if self.levels_only:
            return [Blocks(p, []) for p in paths] or [Blocks("", [])]
        out = []
        with ThreadPoolExecutor(32) as pool:
            for t in pool.map(Tiff, paths):
                for lvl in self._span("lvl", len(t.levels)):
                    v = t.levels[lvl]
                    mine = [(lvl, by, bx) for by in self._span("by", -(-v["h"] // v["bh"])) for bx in self._span("bx", v["across"])]
                    n = max(1, PIXELS // (v["bw"] * v["bh"]))
                    out += [Blocks(t.path, mine[k : k + n]) for k in range(0, len(mine), n)]
        return out or [Blocks("", [])]

    def read(self, part: Blocks) -> Iterator:
        if not part.path:
            return
        t = Tiff(part.path)
        if self.levels_only:
            for k, v in enumerate(t.levels):
                yield (t.path, k, v["w"], v["h"], v["bands"], v["bw"], v["bh"], *t.geo)
            return
        disk, at = place(part.path)
        with disk.open_input_file(at) as f:
            for lvl, by, bx in part.blocks:
                v = t.levels[lvl]
                pixels = t.block(lambda o, n: f.read_at(n, o), lvl, by, bx)
                y, x, band = np.indices(pixels.shape, np.int32).reshape(3, -1)
                n = pixels.size
                same = lambda c, n=n: pa.array(np.full(n, c, np.int32))
                yield pa.record_batch([pa.array([t.path] * n, pa.string()), same(lvl), same(by), same(bx), pa.array(y + np.int32(by * v["bh"])), pa.array(x + np.int32(bx * v["bw"])), pa.array(band), pa.array(pixels.reshape(-1).astype(float))], ["path", "lvl", "by", "bx", "y", "x", "band", "v"])


class TiffSource(DataSource):
    """Options: path (a file or folder), levels (true: one row for each level of each file)."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return LEVELS if str(self.options.get("levels", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def scan(spark: SparkSession, path: str, levels: bool = False) -> DataFrame:
    """Pixels of all blocks, or the levels of all files; filters on lvl, by and bx choose blocks before bytes are read."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiff").option("path", path).option("levels", str(levels).lower()).load()


def block(spark: SparkSession, path: str, lvl: int, by: int, bx: int) -> DataFrame:
    """A block's pixels, from its bytes alone."""
    return scan(spark, path).where((F.col("lvl") == lvl) & (F.col("by") == by) & (F.col("bx") == bx))


def overview(levels: list[dict], scale: float) -> int:
    """The coarsest level that is no coarser than ``scale`` pixels of the file to one of the window's."""
    fits = [k for k, v in enumerate(levels) if levels[0]["w"] / v["w"] <= scale * (1 + 1e-9)]
    return max(fits, key=lambda k: levels[0]["w"] / levels[k]["w"], default=0)


def window(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float, out_w: int, out_h: int, bilinear: bool = False) -> DataFrame:
    """A window of one file, in its pixels, as out_h x out_w values from the overview that its resolution calls for; only the blocks that it meets are read.  What lies outside is 0."""
    from ..operators import points

    t = Tiff(path)
    lvl = overview(t.levels, min(abs(x1 - x0) / out_w, abs(y1 - y0) / out_h))
    v = t.levels[lvl]
    fx, fy = t.levels[0]["w"] / v["w"], t.levels[0]["h"] / v["h"]
    box = x0 / fx, y0 / fy, x1 / fx, y1 / fy
    spare = 1  # of which a bilinear value takes the neighbour
    near = lambda a, b, size: (int((min(a, b) - spare) // size), int((max(a, b) + spare) // size))
    (bx0, bx1), (by0, by1) = near(box[0], box[2], v["bw"]), near(box[1], box[3], v["bh"])
    pixels = scan(spark, path).where((F.col("lvl") == lvl) & (F.col("by") >= by0) & (F.col("by") <= by1) & (F.col("bx") >= bx0) & (F.col("bx") <= bx1) & (F.col("band") == 0))
    return points.raster_window(pixels.select("y", "x", "v"), *box, out_w, out_h, bilinear)


def tiled_bytes(image: np.ndarray, tile: int = 256, overviews: int = 0, origin: tuple[float, float] = (0.0, 0.0), pixel: tuple[float, float] = (1.0, 1.0), deflate: bool = False) -> bytes:
    """A TIFF of (height, width, bands) in tiles (a multiple of 16 a side), each overview every second pixel of the level before."""
    bits, sort = {"uint8": (8, 1), "uint16": (16, 1), "int16": (16, 2), "float32": (32, 3)}[image.dtype.name]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k in range(overviews + 1):
        im = image[:: 1 << k, :: 1 << k]
        h, w, bands = im.shape
        spots, sizes = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                part = np.zeros((tile, tile, bands), im.dtype.newbyteorder("<"))
                got = im[y : y + tile, x : x + tile]
                part[: got.shape[0], : got.shape[1]] = got
                body = zlib.compress(part.tobytes()) if deflate else part.tobytes()
                spots.append(len(out))
                sizes.append(len(body))
                out += body + b"\0" * (len(body) % 2)
        tables = len(out)
        out += struct.pack(f"<{2 * len(spots)}I", *spots, *sizes)
        n = len(spots)
        where = (spots[0], sizes[0]) if n == 1 else (tables, tables + 4 * n)
        geo = len(out)
        out += struct.pack("<9d", pixel[0], pixel[1], 0.0, 0.0, 0.0, 0.0, *origin, 0.0)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 8 if deflate else 1), (277, 3, 1, bands), (322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, where[0]), (325, 4, n, where[1]), (339, 3, 1, sort)]
        tags += [(33550, 12, 3, geo), (33922, 12, 6, geo + 24)] * (k == 0)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<2HII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def mosaic(pixels: DataFrame, size: int, tile: int = 256, overviews: int = 2, pixel: float = 1.0) -> DataFrame:
    """(name, content): pixels (y, x, v) as tiled TIFF files ``<row>_<column>.tif`` of ``size`` a side, placed by their geotransform; a file is one group of a fixed number of pixels."""

    def one(key, t):
        row, col = key[0].as_py(), key[1].as_py()
        v = np.zeros((size, size, 1), np.float32)
        v[t.column("y").to_numpy() - row * size, t.column("x").to_numpy() - col * size, 0] = t.column("v").to_numpy()
        return pa.table({"name": [f"{row}_{col}.tif"], "content": pa.array([tiled_bytes(v, tile, overviews, (col * size * pixel, -row * size * pixel), (pixel, pixel))], pa.binary())})

    at = pixels.select("y", "x", "v", F.floor(F.col("y") / size).cast("int").alias("_r"), F.floor(F.col("x") / size).cast("int").alias("_c"))
    return at.groupBy("_r", "_c").applyInArrow(one, "name string, content binary")
