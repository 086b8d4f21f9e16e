"""Block rasters: a Parquet layout partitioned by level and block row; uncompressed TIFF (A6 to A8) and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "path string, width int, height int, bands int, bits int, a double, b double, c double, d double, e double, f double, levels int, block_w int, block_h int"


def write_blocks(pixels: DataFrame, path: str, block: int = 256, level: int = 0) -> None:
    """Pixels (y, x, v) as files of blocks; readers prune by level, block row and block column."""
    rows = pixels.withColumns({"lvl": F.lit(level), "by": F.expr(f"y div {block}").cast("int"), "bx": F.expr(f"x div {block}").cast("int")})
    rows.repartition("by", "bx").sortWithinPartitions("by", "bx", "y", "x").write.mode("append").partitionBy("lvl", "by").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d")}


def directories(read) -> tuple[str, list[dict]]:
    """(byte order, the tags of each image directory: the raster, then its overviews); ``read(at, n)`` gives n bytes of the file, or what there is of them."""
    head = read(0, 8)
    end = "<" if head[:2] == b"II" else ">"
    if head[:2] not in (b"II", b"MM") or len(head) < 8 or struct.unpack_from(end + "H", head, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, out = struct.unpack_from(end + "I", head, 4)[0], []
    while at and len(out) < 64:
        tags, n = {}, struct.unpack(end + "H", read(at, 2))[0]
        body = read(at + 2, 12 * n + 4)
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + "2HI", body, 12 * k)
            size, code = _KINDS.get(kind, (0, ""))
            if size:
                held = body[12 * k + 8 : 12 * k + 12] if size * count <= 4 else read(struct.unpack_from(end + "I", body, 12 * k + 8)[0], size * count)
                tags[tag] = struct.unpack_from(f"{end}{count}{code}", held)
        out.append(tags)
        at = struct.unpack_from(end + "I", body, 12 * n)[0] if len(body) >= 12 * n + 4 else 0
    return end, out


def _directories(data: bytes) -> tuple[str, list[dict]]:
    return directories(lambda at, n: data[at : at + n])


def tiff_meta(data: bytes) -> tuple:
    """(width, height, bands, bits, a..f, levels, block width, block height) of a TIFF; its geotransform is that of scale and tie point, its
    levels are its directories, and its blocks are tiles, or strips of whole rows."""
    _, ifds = _directories(data)
    tags = ifds[0]
    sx, sy = tags.get(33550, (1.0, 1.0, 0.0))[:2]
    i, j, _, x, y = tags.get(33922, (0.0,) * 6)[:5]
    w, h = tags[256][0], tags[257][0]
    return w, h, tags.get(277, (1,))[0], tags.get(258, (1,))[0], x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy, len(ifds), tags.get(322, (w,))[0], tags.get(323, tags.get(278, (h,)))[0]


def read_meta(files: DataFrame) -> DataFrame:
    """One row for each file of (path, content)."""

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *tiff_meta(bytes(c))) for p, c in zip(pdf.path, pdf.content, strict=True)], columns=[x.split()[0] for x in META.split(", ")])

    return files.select("path", "content").mapInPandas(parse, META)


def tiff_pixels(data: bytes, level: int = 0) -> np.ndarray:
    """(height, width, bands) of an uncompressed TIFF in strips: 8-bit, 16-bit signed or 32-bit float samples."""
    end, ifds = _directories(data)
    tags = ifds[level]
    if tags.get(259, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("only uncompressed strips are read from bytes; the tiff source reads blocks")
    w, h, bands, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(258, (8,))[0]
    kind = {(8, 1): "u1", (16, 2): "i2", (16, 1): "u2", (32, 3): "f4"}.get((bits, tags.get(339, (1,))[0]))
    if kind is None:
        raise ValueError(f"samples of {bits} bits are not read")
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, end + kind, w * h * bands).reshape(h, w, bands)


def read_pixels(files: DataFrame, level: int = 0) -> DataFrame:
    """(path, y, x, band, v) of (path, content); a file at a time, as an uncompressed strip is no smaller than its pixels."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                yield from _pixel_rows(path, tiff_pixels(bytes(content), level))

    return files.select("path", "content").mapInPandas(parse, "path string, y int, x int, band int, v double")


def _pixel_rows(path: str, image: np.ndarray, rows: int = 256):
    h, w, bands = image.shape
    for y in range(0, h, rows):
        part = image[y : y + rows]
        at = np.indices(part.shape, np.int32).reshape(3, -1)
        yield pd.DataFrame({"path": path, "y": at[0] + np.int32(y), "x": at[1], "band": at[2], "v": part.reshape(-1).astype(float)})


def tiff_bytes(image: np.ndarray, origin: tuple[float, float] = (0.0, 0.0), pixel: tuple[float, float] = (1.0, 1.0), overviews: int = 0) -> bytes:
    """An uncompressed TIFF of (height, width, bands), each overview every second pixel of the level before."""
    kinds = {"uint8": (8, 1), "int16": (16, 2), "float32": (32, 3)}
    levels = [image[:: 1 << k, :: 1 << k] for k in range(overviews + 1)]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, im in enumerate(levels):
        body, (bits, sort) = np.ascontiguousarray(im).astype(im.dtype.newbyteorder("<")).tobytes(), kinds[im.dtype.name]
        at = len(out)
        out += body + b"\0" * (len(body) % 2)
        geo = len(out)
        out += struct.pack("<9d", pixel[0], pixel[1], 0.0, 0.0, 0.0, 0.0, *origin, 0.0)
        tags = [(256, 4, 1, im.shape[1]), (257, 4, 1, im.shape[0]), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 1, at), (277, 3, 1, im.shape[2]), (278, 4, 1, im.shape[0]), (279, 4, 1, len(body)), (339, 3, 1, sort)]
        tags += [(33550, 12, 3, geo), (33922, 12, 6, geo + 24)] * (k == 0)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<2HII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- PNG ----------------------------------------------------------------------------------------------------------------------------

PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by colour type (grey, RGB, palette, grey and alpha, RGB and alpha).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG that is not interlaced; a palette is looked up."""
    if data[:8] != PNG:
        raise ValueError("no PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, bits, color, _, _, interlaced = head
    if bits != 8 or interlaced:
        raise ValueError("only 8-bit PNG that is not interlaced is read")
    step = _SAMPLES[color]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w + 1, step), np.uint8)  # a row and a column of zeros before
    for y in range(h):
        line, up, row = raw[y, 1:].reshape(w, step), out[y, 1:], out[y + 1]
        kind = raw[y, 0]
        if kind == 0:
            row[1:] = line
        elif kind == 1:
            row[1:] = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            row[1:] = line + up
        else:  # the mean of left and above, or the one of left, above and corner that is nearest their plane
            for x in range(w):
                a, b, c = row[x].astype(int), out[y, x + 1].astype(int), out[y, x].astype(int)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    far = np.abs(np.stack([b - c, a - c, a + b - 2 * c]))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), a, np.where(far[1] <= far[2], b, c))
                row[x + 1] = (line[x] + guess).astype(np.uint8)
    image = out[1:, 1:]
    return palette[image[:, :, 0]] if color == 3 else image


def png_bytes(image: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of (height, width, 1, 3 or 4) bytes; the rows take the filters in turn."""
    h, w, step = image.shape
    x = np.zeros((h + 1, w + 1, step), int)
    x[1:, 1:] = image
    now, left, up, corner = x[1:, 1:], x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
    plane = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    kinds = [now, now - left, now - up, now - (left + up) // 2, now - plane]
    rows = b"".join(bytes([k]) + kinds[k][y].astype(np.uint8).tobytes() for y in range(h) for k in [filters[y % len(filters)]])
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return PNG + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_png(files: DataFrame) -> DataFrame:
    """(path, y, x, band, v) of PNG files as (path, content)."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                yield from _pixel_rows(path, png_pixels(bytes(content)))

    return files.select("path", "content").mapInPandas(parse, "path string, y int, x int, band int, v double")
