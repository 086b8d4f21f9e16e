"""Files that are published whole or not at all, and rasters that are read by blocks."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from cloudgrid.functions.lineage import fresh
from cloudgrid.sources import las, raster, sink, tiff


def left(path) -> list[str]:
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_only_committed_attempts_are_published(tmp_path):
    """A task runs twice, as when its executor is lost after it wrote: one attempt's files are published, and none is left over."""
    w = sink.BlobWriter(str(tmp_path))
    first = w.write(iter([Row(name="a.bin", content=b"one"), Row(name="b.bin", content=b"two")]))
    again = w.write(iter([Row(name="a.bin", content=b"one"), Row(name="b.bin", content=b"two")]))
    other = w.write(iter([Row(name="c.bin", content=None)]))
    assert left(tmp_path) == [w.job] and first.files != again.files
    w.commit([again, other, None])
    assert left(tmp_path) == ["a.bin", "b.bin", "c.bin"] and (tmp_path / "a.bin").read_bytes() == b"one" and (tmp_path / "c.bin").read_bytes() == b""


def test_an_aborted_job_leaves_nothing(tmp_path):
    w = sink.BlobWriter(str(tmp_path))
    w.write(iter([Row(name="a.bin", content=b"one")]))
    w.abort([None])
    assert left(tmp_path) == []


@pytest.mark.parametrize("rows", [[("a", b"1"), ("a", b"2")], [("../a", b"1")], [("", b"1")], [(None, b"1")], [("_a", b"1")]])
def test_names_that_are_none_or_twice_fail_the_job(spark, tmp_path, rows):
    (tmp_path / "kept").write_bytes(b"x")
    with pytest.raises(PySparkException):
        sink.write_each(spark.createDataFrame([*rows, ("z", b"3")], "name string, content binary").repartition(3), str(tmp_path))
    assert left(tmp_path) == ["kept"]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(6).select(F.concat("id", F.lit(".bin")).alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(PySparkException):
        sink.write_each(rows, str(tmp_path / "out"))
    assert left(tmp_path / "out") == []


def test_files_come_back(spark, tmp_path):
    rows = spark.range(1, 20).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "UTF-8").alias("content"))
    sink.write_each(rows.repartition(4), f"file://{tmp_path}/out")
    got = spark.read.format("binaryFile").load(str(tmp_path / "out")).select(F.substring_index("path", "/", -1).alias("name"), "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    sink.write_each(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "none"))
    assert left(tmp_path / "none") == []


def test_las_files_are_written_by_pieces(spark, tmp_path, monkeypatch):
    """No call sees a whole file's points; the files are those of the writer of one file, byte for byte."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        p = spark.range(2000).selectExpr("id % 3 f", "id * 7919 % 4096 / 4096 x", "id * 6151 % 4096 / 4096 - 3 y", "id % 50 / 64 z", "id i")
        whole, most = las.write_pieces, []
        monkeypatch.setattr(las, "write_pieces", lambda rows, to: (most.append(rows.agg(F.max(F.length("content"))).first()[0]), whole(rows, to)))
        las.write_files(p, f"{tmp_path}/las", "f", ["x", "y", "z", "i"], 1 / 4096, "i")
        assert most[0] <= 227 + 100 * 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = p.toPandas()
    for f, g in t.groupby("f"):
        g = g.sort_values(["x", "y", "z", "i"])
        las.write_las(f"{tmp_path}/one.las", g[["x", "y", "z"]].to_numpy(), g.i.to_numpy() % 65536, 1 / 4096)
        assert open(f"{tmp_path}/one.las", "rb").read() == open(f"{tmp_path}/las/{f}.las", "rb").read()
    assert las.scan(spark, f"{tmp_path}/las", headers=True).agg(F.sum("n_points")).first()[0] == 2000


def test_pieces_out_of_order_fail_the_job(spark, tmp_path):
    for rows in ([("a", b"1", 1)], [("a", b"1", 0), ("b", b"2", 1)], [("a", b"1", 0), ("a", b"2", 2)]):
        with pytest.raises(Exception, match="doesn't follow"):
            sink.write_pieces(spark.createDataFrame(rows, "name string, content binary, piece long").coalesce(1), str(tmp_path / "p"))
        assert not [f for f in os.listdir(tmp_path / "p") if f in "ab"]


def test_folders_that_no_file_system_is_known_for_are_refused(spark):
    with pytest.raises(ValueError, match="no file system"):
        sink.place("nowhere://node/a")
    with pytest.raises(PySparkException):
        sink.write_each(spark.createDataFrame([("a", b"1")], "name string, content binary"), "nowhere://node/a")
    with pytest.raises(ValueError, match="local or mounted"):
        las.local("nowhere://node/a")
    assert las.local("file:///a") == las.local("/a") == "/a"


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).integers(0, 255, (70, 100, 2)).astype(np.uint8)


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("layout", ["tiles", "strips"])
def test_all_blocks_make_the_image(spark, tmp_path, image, layout, deflate):
    if layout == "strips" and deflate:
        return
    (tmp_path / "a.tif").write_bytes(tiff.tiled_bytes(image, 32, 2, deflate=deflate) if layout == "tiles" else raster.tiff_bytes(image, overviews=2))
    (tmp_path / "notes.txt").write_bytes(b"no image")
    for lvl in range(3):
        got = tiff.scan(spark, str(tmp_path)).where(f"lvl = {lvl}").toPandas()
        want = image[:: 1 << lvl, :: 1 << lvl]
        back = np.full(want.shape, -1)
        back[got.y, got.x, got.band] = got.v
        assert len(got) == want.size and (back == want).all()


def test_only_the_blocks_asked_for_are_read(spark, tmp_path, image):
    at = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(tiff.tiled_bytes(image, 16, 1))
    t, read = tiff.Tiff(at), []
    t.block(lambda o, n: read.append((o, n)) or open(at, "rb").read()[o : o + n], 0, 2, 3)
    assert [n for _, n in read] == [16 * 16 * 2]
    q = tiff.block(spark, at, 0, 2, 3)
    assert q.count() == 16 * 16 * 2 and {(r.by, r.bx) for r in q.select("by", "bx").distinct().collect()} == {(2, 3)}
    r = tiff.TiffReader({"path": at})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    list(r.pushFilters([EqualTo(("lvl",), 0), GreaterThan(("by",), 1), LessThanOrEqual(("bx",), 1)]))
    assert [b for p in r.partitions() for b in p.blocks] == [(0, by, bx) for by in (2, 3, 4) for bx in (0, 1)]


def test_a_window_comes_from_the_overview_of_its_resolution(spark, tmp_path):
    y, x = np.indices((128, 128))
    at = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(tiff.tiled_bytes((y * 128 + x).astype(np.float32)[:, :, None], 16, 3))
    for x0, y0, edge, n in ((0, 0, 128, 128), (16, 32, 64, 16), (8, 8, 32, 16), (100, -8, 40, 40), (64, 64, 64, 8)):
        scale = edge // n
        got = tiff.window(spark, at, x0, y0, x0 + edge, y0 + edge, n, n).toPandas().set_index(["oy", "ox"]).v
        for j in range(0, n, 3):
            for i in range(0, n, 3):
                yy, xx = y0 + j * scale, x0 + i * scale
                assert got[j, i] == (yy * 128 + xx if 0 <= yy < 128 and 0 <= xx < 128 else 0)
    assert [tiff.overview(tiff.Tiff(at).levels, s) for s in (0.5, 1, 1.9, 2, 5, 100)] == [0, 0, 0, 1, 2, 3]


def test_no_rasters(spark, tmp_path):
    assert tiff.scan(spark, str(tmp_path)).collect() == [] and tiff.scan(spark, str(tmp_path), levels=True).collect() == []
    (tmp_path / "a.tif").write_bytes(b"II*")
    with pytest.raises(PySparkException):
        tiff.scan(spark, str(tmp_path)).collect()


def test_a_mosaic_of_files(spark):
    at = fresh(spark, "mosaic")
    p = spark.range(48 * 40).selectExpr("cast(id div 40 as int) y", "cast(id % 40 as int) x", "cast(id as double) v")
    sink.write_each(tiff.mosaic(p, 32, 16, 1), at)
    got = tiff.scan(spark, at).where("lvl = 0").join(tiff.scan(spark, at, levels=True).where("lvl = 0").select("path", "a", "d"), "path")
    back = got.select((F.col("y") - F.col("d")).alias("y"), (F.col("x") + F.col("a")).alias("x"), "v").where("y < 48 and x < 40")
    assert back.count() == 48 * 40 and back.where("v <> y * 40 + x").count() == 0
