"""Small inputs with known answers."""

import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrid.functions import scalar
from cloudgrid.functions.lineage import settle
from cloudgrid.operators import bricks, graphs, images, points, surfaces, tiles3d, voxels
from cloudgrid.sources import gltf, las, raster, tileset
from cloudgrid.streaming import counts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_one_voxel_per_level(spark):
    p = frame(spark, [(0.5, 0.5, 0.5)], "x double, y double, z double")
    assert {r.lvl: r.n for r in voxels.octree(p, 4, 1).collect()} == {4: 1, 3: 1, 2: 1, 1: 1}


def test_points_outside_are_left_out(spark):
    p = frame(spark, [(-0.1, 0.5, 0.5), (0.5, 1.0, 0.5), (0.2, 0.2, 0.2)], "x double, y double, z double")
    assert voxels.voxelize(p, 3).count() == 1


def test_block_of_eight_needs_no_balance(spark):
    fine = frame(spark, [(x, y, z, 1.0) for x in (0, 1) for y in (0, 1) for z in (0, 1)], "x int, y int, z int, val double")
    assert voxels.missing_siblings(fine).count() == 0
    assert voxels.with_children(voxels.coarser(fine, sums=("val",)), fine).count() == 1
    assert voxels.leaves(voxels.coarser(fine, sums=("val",)), fine).count() == 0


def test_outliers_go_and_their_neighbours_stay(spark):
    at = lambda i, j, k, n: [((i + 0.5) / 8, (j + 0.5) / 8, (k + 0.5) / 8)] * n
    p = frame(spark, at(2, 2, 2, 6) + at(3, 3, 2, 1) + at(4, 2, 2, 1) + at(2, 2, 3, 5) + at(7, 7, 7, 5) + [(1.5, 0.1, 0.1)], "x double, y double, z double")
    kept = voxels.filter_outliers(p, 3).groupBy("x", "y", "z").count().collect()
    assert {(int(r.x * 8), int(r.y * 8), int(r.z * 8)): r["count"] for r in kept} == {(2, 2, 2): 6, (3, 3, 2): 1}


def test_normal_of_a_tilted_plane_at_two_levels(spark):
    """x + z = constant: the normal is (1, 0, 1) / sqrt 2 on both levels."""
    v = spark.range(16 * 16).selectExpr("cast(id % 16 as int) x", "cast(id div 16 as int) y", "cast(20 - id % 16 as int) z", "1D val")
    n = voxels.normals_multilevel(v, 2).where("x between 5 and 10 and y between 5 and 10").collect()
    assert len(n) == 36
    for r in n:
        assert abs(r.nx) == pytest.approx(0.5**0.5, abs=0.05) and r.nx * r.nz > 0 and abs(r.ny) < 1e-6 and r.nx**2 + r.ny**2 + r.nz**2 == pytest.approx(1)


def test_box_mesh_is_closed(spark):
    t = surfaces.box_mesh(spark).toPandas()
    edges = {}
    for _, g in t.sort_values("corner").groupby("tid"):
        p = list(zip(g.x, g.y, g.z, strict=True))
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            edges[a, b] = edges.get((a, b), 0) + 1
    assert len(t) == 36 and all(n == 1 and (b, a) in edges for (a, b), n in edges.items())


def test_exact_quantiles(spark, monkeypatch):
    r = np.random.default_rng(3)
    columns = {"a": r.lognormal(0, 5, 5000), "b": np.round(r.random(5000), 2), "c": np.full(5000, 7.0)}
    q = (0.0, 1e-4, 0.25, 0.5, 0.9985, 1.0)
    df = spark.createDataFrame(list(zip(*(x.tolist() for x in columns.values()), strict=True)) + [(None, float("nan"), None)], "a double, b double, c double")
    for exact in (1 << 16, 3):
        monkeypatch.setattr(points, "EXACT", exact)
        got = points.exact_quantiles(df, dict.fromkeys(columns, q))
        for c, x in columns.items():
            assert np.allclose(got[c], np.quantile(x, q), rtol=1e-12), c
    assert points.exact_quantiles(df.limit(0), {"a": (0.5,)}) == {"a": [None]} and points.quantile_trim(df.limit(0), {"a": (0.1, 0.9)}).count() == 0


def test_ranks(spark):
    x = np.random.default_rng(4).integers(0, 50, 3000).tolist()
    got = points.ranked(spark.createDataFrame([(v,) for v in x], "v long").repartition(7), "v").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(3000)) and [r.v for r in got] == sorted(x)


def test_normal_of_a_plane(spark):
    v = spark.range(81).selectExpr("cast(id % 9 as int) x", "cast(id div 9 as int) y", "4 z", "1D val")
    n = voxels.normals(voxels.covariances(v)).where("x = 4 and y = 4").first().normal
    assert np.allclose(n, [0, 0, 1])
    assert {r.mask for r in voxels.visibility(v).collect()} == {255}


def test_constant_image(spark):
    g = points.grid(spark, 16, 16).select("y", "x", F.lit(0.5).alias("v"), F.lit(1.0).alias("w"))
    assert {round(r.v, 9) for r in images.push_pull(g, 2).collect()} == {0.5}
    assert {r.v for r in images.median(g, 3).collect()} == {0.5}


def test_marching_cubes_of_one_corner():
    assert len(surfaces.cube_triangles(1)) == 1 and surfaces.cube_triangles(0) == surfaces.cube_triangles(255) == []
    assert max(len(surfaces.cube_triangles(i)) for i in range(256)) == 5
    # the joins close: every edge of a loop's boundary is a cut edge of the cell
    for i in range(256):
        for t in surfaces.cube_triangles(i):
            for e in t:
                a, b = surfaces.EDGES[e]
                assert bool(i >> a & 1) != bool(i >> b & 1)


def test_sphere_of_marching_cubes_is_closed(spark):
    v = spark.range(16**3).selectExpr("cast(id % 16 as int) x", "cast(id div 16 % 16 as int) y", "cast(id div 256 as int) z")
    v = v.withColumn("val", 6.5 - F.sqrt((F.col("x") - 7.3) ** 2 + (F.col("y") - 7.6) ** 2 + (F.col("z") - 7.1) ** 2))
    t = surfaces.marching_cubes(v, 4, 0.5).toPandas()
    t["p"] = list(zip(t.px.round(7), t.py.round(7), t.pz.round(7), strict=True))
    edges = {}
    for _, g in t.sort_values("corner").groupby(["x", "y", "z", "seq"]):
        p = list(g.p)
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            if a != b:
                edges[a, b] = edges.get((a, b), 0) + 1
    assert edges and all(edges.get((b, a)) == n for (a, b), n in edges.items())


def test_pillar_mesh_is_closed_at_its_sides(spark):
    s = points.grid(spark, 8, 8).withColumn("v", F.when((F.col("x") == 4) & (F.col("y") == 4), 0.5).otherwise(0.1))
    n = surfaces.surface_nodes(s, 8)
    masks = {r.z: r["mask"] for r in n.where("x = 4 and y = 4").collect()}
    assert masks and all(m & 60 == 60 for z, m in masks.items() if 3 <= z <= 4)
    t = surfaces.numbered(surfaces.triangles(n, 8))
    assert t.count() == 2 * surfaces.faces(n).count()


def test_long_smoothing_equals_rounds(spark):
    """Tiles with halos, several exchanges and a last one of fewer rounds, against a round at a time."""
    n = surfaces.surface_nodes(points.grid(spark, 9, 9).withColumn("v", (F.col("x") * F.col("y")) / 64.0), 9)
    t = settle(surfaces.numbered(surfaces.triangles(n, 9)))
    v, s = settle(surfaces.vertices(n, 9)), surfaces.slots(t)
    near = surfaces.corners_beside(s, t).toPandas()
    p = v.orderBy("vid").toPandas()
    now, ids = p[["x", "y", "z"]].to_numpy(), p.vid.to_numpy()
    weight = np.zeros((len(ids), len(ids)))
    weight[np.searchsorted(ids, near.vid), np.searchsorted(ids, near.o)] = near.m
    weight /= weight.sum(1, keepdims=True)
    for _ in range(7):
        now = 0.9 * now + 0.1 * weight @ now
    kept = lambda: set(Path(v.inputFiles()[0].removeprefix("file:")).parents[1].iterdir())
    before = kept()
    tiled = surfaces.smooth_tiles(v, s, t, 0.9, 7, cells=4, rings=3)
    assert len(kept() - before) == 1  # the result; what led to it is gone
    tiled = tiled.orderBy("vid").toPandas()
    assert (tiled.vid == ids).all() and np.allclose(tiled[["x", "y", "z"]], now, atol=1e-12)
    two = surfaces.smooth(v, s, t, 0.9, 2).orderBy("vid").toPandas()
    assert np.allclose(two[["x", "y", "z"]], surfaces.smooth_tiles(v, s, t, 0.9, 2, 4, 3).orderBy("vid").toPandas()[["x", "y", "z"]], atol=1e-12)
    assert surfaces.mesh_tiles(v, surfaces.corners_beside(s, t), 4, 3).where("ring = 0").count() == len(ids)


def test_shifted_image_is_found(spark):
    a = points.grid(spark, 64, 64).withColumn("v", F.pmod(F.xxhash64("y", "x"), F.lit(97)) / 97.0)
    b = a.select("y", (F.col("x") - 5).alias("x"), "v").where("x >= 0")
    p = images.align(a, b, 64, 64, 32, 8, gradients=False).toPandas()
    assert (p.dx.abs() == 5).mean() > 0.7 and (p.dy == 0).mean() > 0.7


def augmented(edges, s, t):
    """Value of the largest flow, by shortest augmenting paths."""
    left = {}
    for u, v, c in edges:
        left.setdefault(u, {})[v] = left.get(u, {}).get(v, 0) + c
        left.setdefault(v, {}).setdefault(u, 0)
    value = 0
    while True:
        back, queue = {s: s}, [s]
        for u in queue:
            for v, c in left.get(u, {}).items():
                if c > 0 and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            return value
        path = [t]
        while path[-1] != s:
            path.append(back[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        least = min(left[u][v] for u, v in steps)
        for u, v in steps:
            left[u][v] -= least
            left[v][u] += least
        value += least


def proven(spark, e, s, t):
    """The flow's value, after checks of capacity, balance and cut."""
    f = graphs.max_flow(frame(spark, e, "u int, v int, c int"), s, t)
    r = f.toPandas()
    assert dict(f.dtypes) == {"u": "int", "v": "int", "c": "int", "flow": "int"} and len(r) == len(e)
    assert ((r.flow >= 0) & (r.flow <= r.c)).all()
    out, into = r.groupby("u").flow.sum(), r.groupby("v").flow.sum()
    for node in set(r.u) | set(r.v):
        if node not in (s, t):
            assert out.get(node, 0) == into.get(node, 0)
    side = {x.node: x.side for x in graphs.cut_sides(f, s).collect()}
    assert side[s] == "S" and side[t] == "T" and set(side) == set(r.u) | set(r.v)
    across = r[(r.u.map(side) == "S") & (r.v.map(side) == "T")]
    value = into.get(t, 0) - out.get(t, 0)
    assert value == across.c.sum()
    assert "0 -> 1" in graphs.dot(f).first().dot
    return value


def test_flow_of_hubs_dead_ends_and_ways_back(spark):
    r = np.random.default_rng(5)
    e = {(0, 1): 3}
    for _ in range(60):
        u, v = (int(x) for x in r.integers(0, 14, 2))
        if u != v:
            e[u, v] = int(r.integers(0, 9))
    e |= {(1, k): 1 for k in range(20, 90)} | {(k, 13): 1 for k in range(20, 60)} | {(0, 1): 60, (5, 200): 4, (201, 5): 7}
    e = [(u, v, c) for (u, v), c in e.items()]
    assert proven(spark, e, 0, 13) == augmented(e, 0, 13) > 20


def test_rounds_look_at_downhill_arcs_only(spark, monkeypatch):
    """What a round reads is the arcs that lead one lower, once for each search, and hubs' arcs go in several buckets."""
    e = [(0, k, 3) for k in range(2, 42)] + [(k, 42 + k % 7, 2) for k in range(2, 42)] + [(42 + k, 1, 9) for k in range(7)]
    monkeypatch.setattr(graphs, "BUCKET_ARCS", 2)
    found, down, handed = [], graphs._downhill, graphs._handed_out

    def seen(pairs, nodes):
        h = {r.node: r.h for r in nodes.collect()}
        arcs, out = down(pairs, nodes)
        found.append([(r.u, r.v) for r in arcs.collect()])
        assert found[-1] and all(h[u] == h[v] + 1 for u, v in found[-1]) and len(found[-1]) < 2 * len(e)
        return arcs, out

    monkeypatch.setattr(graphs, "_downhill", seen)
    most = []
    monkeypatch.setattr(graphs, "_handed_out", lambda arcs: (most.append(arcs.agg(F.max("many")).first()[0]), handed(arcs))[1])
    assert proven(spark, [(u, v, c) for u, v, c in e], 0, 1) == augmented(e, 0, 1) == 63
    assert len(found) <= 3 and max(most) > 1


def test_no_flow_where_nothing_leads_to_the_sink(spark):
    assert proven(spark, [(0, 1, 5), (1, 2, 5), (3, 4, 1)], 0, 4) == 0


# --- bricks, prefixes and columns -----------------------------------------------------------------------------------------------------


def scattered(seed, n, span, low=0):
    r = np.random.default_rng(seed)
    c = np.unique(r.integers(low, low + span, (n, 3)), axis=0)
    return {tuple(int(v) for v in row): float(k % 7 + 1) for k, row in enumerate(c)}


def cells(spark, held):
    return frame(spark, [(*c, v) for c, v in held.items()], "x int, y int, z int, val double").repartition(5)


@pytest.mark.parametrize("low", [0, -21])
def test_neighbourhoods_by_bricks_are_the_direct_ones(spark, low):
    held = scattered(1, 3000, 40, low)
    got = {(r.x, r.y, r.z): r for r in voxels.covariances(cells(spark, held)).collect()}
    sums = {(r.x, r.y, r.z): (r.k, r.total) for r in voxels.neighbour_sums(cells(spark, held)).collect()}
    assert set(got) == set(sums) == set(held)
    around = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)]
    for c in list(held)[:400]:
        near = [(d, held[t]) for d in around if (t := tuple(np.add(c, d).tolist())) in held]
        assert got[c].support == sum(v for _, v in near)
        for name, a, b in (("xx", 0, 0), ("yz", 1, 2), ("xz", 0, 2)):
            assert got[c][name] == pytest.approx(sum(v * d[a] * d[b] / max(sum(q * q for q in d), 1) for d, v in near), abs=1e-9)
        one = [v for d, v in near if max(map(abs, d)) <= 1]
        assert sums[c] == (len(one), sum(one))


def test_a_brick_sees_few_more_rows_than_its_own(spark):
    full = spark.range(64**3).selectExpr("cast(id % 64 as int) x", "cast(id div 64 % 64 as int) y", "cast(id div 4096 as int) z", "1D val")
    dealt = bricks.deal(full, ["x", "y", "z"], 2)
    assert dealt.count() < 2 * 64**3
    sizes = dealt.groupBy("_b").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 20**3 and sizes[1] == 6**3  # those beside the cube see its border
    assert [r.n for r in voxels.neighbour_sums(full).groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()] == [8, 12 * 62, 6 * 62**2, 62**3]


def test_median_by_squares(spark):
    r = np.random.default_rng(2)
    img = r.random((150, 140))
    i = frame(spark, [(int(y), int(x), float(img[y, x])) for y in range(150) for x in range(140)], "y int, x int, v double").repartition(4)
    got = images.median(i, 5).toPandas().set_index(["y", "x"]).v
    for y, x in ((0, 0), (127, 127), (128, 128), (149, 139), (70, 1), (126, 130)):
        assert got[y, x] == pytest.approx(np.median(img[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3]))


def test_morton_keys_hold_their_parents(spark):
    r = np.random.default_rng(3)
    c = r.integers(-(1 << 20), 1 << 20, (200, 3)).tolist()
    p = frame(spark, c, "x int, y int, z int").select("x", "y", "z", scalar.morton("x", "y", "z").alias("m"), scalar.morton(F.shiftright("x", 4), F.shiftright("y", 4), F.shiftright("z", 4)).alias("up"))
    kept = (1 << 51) - 1
    for r in p.collect():
        assert r.m == sum(((r.x >> k & 1) | (r.y >> k & 1) << 1 | (r.z >> k & 1) << 2) << 3 * k for k in range(21))
        assert r.m >> 12 == r.up & kept


def test_deep_trees_are_those_of_each_level(spark):
    """More levels than one block takes, against a grouping of each level."""
    r = np.random.default_rng(4)
    pts = np.clip(np.concatenate([r.random((300, 3)), 0.3 + r.normal(0, 1e-3, (600, 3))]), 0, 0.999)
    p = frame(spark, pts.tolist(), "x double, y double, z double").repartition(3)
    got = {(t.lvl, t.x, t.y, t.z): (t.n, t.val) for t in voxels.octree(p, 13, 0).collect()}
    want = {}
    for lv in range(14):
        for c in np.floor(pts * (1 << lv)).astype(int).tolist():
            n, v = want.get((lv, *c), (0, 0.0))
            want[(lv, *c)] = (n + 1, v + 1.0)
    assert got == want
    dens = {(t.x, t.y, t.z): t.density for t in voxels.density(p, 9, 8).collect()}
    for c in list(dens)[:100]:
        assert dens[c] == pytest.approx(sum(want[(9 - i, *[v >> i for v in c])][0] * 0.5**i for i in range(8)))


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_levels_come_from_one_scan_and_one_shuffle_of_points(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_quantity / 64 x", "l_discount y", "l_tax z")
    plans = [voxels.octree(p, 6, 2), voxels.level_stats(voxels.octree(p, 6, 2)), voxels.density(p, 5)]
    assert [scans(x) for x in plans] == [1, 1, 1]
    # partial sums of points by cell, and cells by prefix
    assert [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (plans[0], plans[2])] == [2, 2]


def test_sky_masks_by_columns_are_the_direct_ones(spark):
    """Columns of several words, squares with halos, and cells below 0."""
    held = set(scattered(6, 900, 30)) | {(x, y, z * 9 - 100) for x, y, z in scattered(7, 500, 50)} | {(x, y, z + 400) for x, y, z in scattered(8, 300, 100, -40)}
    got = {(r.x, r.y, r.z): r.mask for r in voxels.visibility(cells(spark, dict.fromkeys(held, 1.0))).collect()}
    assert set(got) == held
    for x, y, z in held:
        mask = 255
        for i, (dx, dy) in enumerate(voxels.RAYS):
            if any((x + dx * p, y + dy * p, h) in held for p in range(voxels.STEPS) for h in range(z + p * voxels.RISE, z + (p + 1) * voxels.RISE) if h > z):
                mask -= 1 << i
        assert got[x, y, z] == mask, (x, y, z)
    assert voxels.visibility(cells(spark, {(0, 0, 0): 1.0}).limit(0)).collect() == []


def test_a_chain_of_a_hundred(spark):
    """Neither breadth-first search nor a tile tree ends before its data does."""
    e = spark.range(100).selectExpr("cast(id as int) u", "cast(id + 1 as int) v")
    assert {r.node: r.hop for r in graphs.hops(e, 0).collect()} == {i: i for i in range(101)}
    with pytest.raises(ValueError, match="more than 20 edges"):
        graphs.hops(e, 0, 20)
    t = spark.range(100).selectExpr("cast(id as string) tile_id", "case when id > 0 then cast(id - 1 as string) end parent_id", "case when id = 0 then 5D end geo_error", "case when id = 0 then 'ADD' end refine", "named_struct('type', 'sphere', 'vals', array(0D, 0D, 0D, 1D)) bv", "cast(array(1,0,0,1, 0,1,0,0, 0,0,1,0, 0,0,0,1) as array<double>) xform")
    got = {int(r.tile_id): r for r in tiles3d.inherit(t).collect()}
    assert len(got) == 100 and all(r.depth == i and r.xform[3] == i + 1 and r.geo_error == 5 and r.refine == "ADD" for i, r in got.items())
    assert tiles3d.visited(tiles3d.inherit(t).withColumn("sse", F.lit(99.0))).count() == 100


def test_utm_of_known_places(spark):
    """On a zone's meridian the easting is the false one, and the northing 0.9996 times the meridian's length."""
    p = frame(spark, [(3.0, 0.0), (3.0, 45.0), (9.0, -45.0), (2.2945, 48.8582)], "lon double, lat double").withColumn("zone", scalar.utm_zone(F.col("lon")))
    e, n = scalar.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    r = p.select("zone", e.alias("e"), n.alias("n")).collect()
    assert [x.zone for x in r] == [31, 31, 32, 31] and [x.e for x in r[:3]] == pytest.approx([5e5] * 3, abs=1e-6)
    assert [x.n for x in r[:3]] == pytest.approx([0, 0.9996 * 4984944.378, 1e7 - 0.9996 * 4984944.378], abs=2e-3)
    assert (r[3].e, r[3].n) == pytest.approx((448252, 5411943), abs=15)


def test_png_round_trip_of_all_filters(spark):
    r = np.random.default_rng(5)
    for channels in (1, 2, 3, 4):
        im = r.integers(0, 256, (11, 7, channels), dtype=np.uint8)
        assert (raster.png_pixels(raster.png_bytes(im, (0, 1, 2, 3, 4))) == im).all()
    got = raster.read_png(frame(spark, [("a.png", bytearray(raster.png_bytes(im)))], "path string, content binary")).toPandas()
    assert len(got) == im.size and got[(got.y == 3) & (got.x == 2) & (got.band == 1)].v.iloc[0] == im[3, 2, 1]


def test_tiff_with_overviews():
    for kind in (np.uint8, np.int16, np.float32):
        im = (np.arange(12 * 10 * 3).reshape(12, 10, 3) % 120).astype(kind)
        data = raster.tiff_bytes(im, (7.0, 9.0), (0.5, 0.25), 2)
        assert raster.tiff_meta(data)[:4] == (10, 12, 3, im.itemsize * 8) and raster.tiff_meta(data)[4:10] == (7, 0.5, 0, 9, 0, -0.25) and raster.tiff_meta(data)[10] == 3
        assert (raster.tiff_pixels(data) == im).all() and (raster.tiff_pixels(data, 2) == im[::4, ::4]).all()


def test_delaunay_by_tiles_is_that_of_all_points(spark):
    """Every tetrahedron of the tiles is one of the whole triangulation, and each that fits into a halo is made once."""
    q = np.random.default_rng(2).random((300, 3))
    whole = surfaces.tetrahedra(np.unique(q, axis=0))
    known = {tuple(sorted(map(tuple, np.unique(q, axis=0)[t]))) for t in whole}
    got = [tuple(sorted((tuple(r[f"{c}{a}"] for a in "xyz") for c in "abcd"))) for r in surfaces.delaunay_tiles(frame(spark, q.tolist(), "x double, y double, z double"), 0.5, 0.25).collect()]
    assert len(got) == len(set(got)) and set(got) <= known and len(got) > 0.7 * len(known)


def test_delaunay_spheres_are_empty():
    p = np.random.default_rng(1).random((25, 3))
    t = surfaces.tetrahedra(p)
    assert len(t)
    for q in t:
        a = p[q[0]]
        c = np.linalg.solve(2 * (p[q[1:]] - a), (p[q[1:]] ** 2).sum(1) - (a**2).sum())
        assert (((p - c) ** 2).sum(1) >= ((a - c) ** 2).sum() - 1e-9).all()


def test_delaunay_of_sets_beside_each_other():
    """Sets of any sizes and orders get what each gets alone, and the whole convex hull of points in it is filled."""
    r = np.random.default_rng(7)
    sets = [r.random((n, 3)) for n in (60, 3, 0, 25, 61, 200, 4)]
    sets.append(np.unique(np.floor(r.random((150, 3)) * (4096, 4096, 4)) / (4096, 4096, 4), axis=0))  # in few planes
    got = surfaces.tetrahedra_of(sets)
    assert [len(t) for t in got[1:3]] == [0, 0]
    for p, t in zip(sets, got, strict=True):
        assert (t == surfaces.tetrahedra(p)).all()
        for q in t:
            a = p[q[0]]
            c = np.linalg.solve(2 * (p[q[1:]] - a), (p[q[1:]] ** 2).sum(1) - (a**2).sum())
            assert (((p - c) ** 2).sum(1) >= ((a - c) ** 2).sum() - 1e-9 * ((a - c) ** 2).sum().clip(1)).all()
    corners = np.concatenate([np.array(np.meshgrid([0, 1], [0, 1], [0, 1])).reshape(3, 8).T, r.random((80, 3))])
    t = surfaces.tetrahedra(corners)
    assert abs(np.abs(np.linalg.det(corners[t[:, 1:]] - corners[t[:, :1]])).sum() / 6 - 1) < 1e-9


def test_las_round_trip_and_pruning(spark, tmp_path):
    r = np.random.default_rng(0)
    a, b = r.random((500, 3)) * 10, r.random((300, 3)) * 10 + 100
    las.write_las(f"{tmp_path}/a.las", a, np.arange(500))
    las.write_las(f"{tmp_path}/b.LAS", b, form=3)
    spark.dataSource.register(las.LasSource)
    df = spark.read.format("las").option("path", str(tmp_path)).load()
    assert df.count() == 800
    got = df.where("x < 50").orderBy("pt_idx").toPandas()
    assert np.allclose(got[["x", "y", "z"]], a, atol=1e-3) and list(got.intensity) == list(range(500))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    near = spark.read.format("las").option("path", str(tmp_path)).option("pushdown", "true").load().where("x < 50")
    assert near.count() == 500 and near.rdd.getNumPartitions() == 1
    h = spark.read.format("las").option("path", str(tmp_path)).option("headers", "true").load().toPandas()
    assert sorted(h.n_points) == [300, 500] and points.extent(spark.createDataFrame(h[["min_x", "min_y", "max_x", "max_y"]])).first().max_x > 100
    s = points.stride_sample(df, 8, "path", ["pt_idx"])
    assert s.count() == 63 + 38
    with pytest.raises(ValueError, match="LAZ"):
        open(f"{tmp_path}/c.laz", "wb").write(open(f"{tmp_path}/a.las", "rb").read())
        las.header(f"{tmp_path}/c.laz")


def test_glb_round_trip(spark):
    doc = {"nodes": [{"mesh": 0}, {"mesh": 1, "children": [0]}], "scenes": [{"nodes": [0, 1]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "indices": 2}]}, {"primitives": [{"attributes": {"POSITION": 0}, "mode": 1, "material": 0}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 0, "byteOffset": 12, "componentType": 5126, "count": 4, "type": "VEC4"}, {"bufferView": 1, "componentType": 5121, "count": 6, "type": "SCALAR"}], "bufferViews": [{"buffer": 0, "byteLength": 112, "byteStride": 28}, {"buffer": 0, "byteOffset": 112, "byteLength": 6}], "buffers": [{"byteLength": 118}], "materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}}}], "textures": [{"source": 0}], "images": [{"uri": "data:image/png;base64,AQID"}]}
    body = bytes(range(118))
    glb = gltf.join_glb(json.dumps(doc), body)
    b3dm = struct.pack("<7I", gltf.B3DM_MAGIC, 1, 28 + 4 + len(glb), 4, 0, 0, 0) + b"{}  " + glb
    m = gltf.read_models(frame(spark, [("m.glb", bytearray(glb)), ("t.b3dm", bytearray(b3dm)), ("p.gltf", bytearray(json.dumps(doc).encode()))], "path string, content binary"))
    t = gltf.entities(m)
    n = {(r.model_id, r.entity): r.n for r in gltf.summary(t).collect()}
    assert n["m.glb", "nodes"] == 2 and n["t.b3dm", "accessors"] == 3 and n["p.gltf", "primitives"] == 2 and ("m.glb", "samplers") not in n
    assert [r["mode"] for r in t["primitives"].where("model_id = 'm.glb'").orderBy("mesh").collect()] == [4, 1]
    assert gltf.attributes(t).where("model_id = 'm.glb'").count() == 3
    assert gltf.texture_images(t).where("model_id = 'm.glb'").first().uri.startswith("data:")
    assert bytes(gltf.view_bytes(m, t).where("model_id = 'm.glb' and idx = 1").first().data) == body[112:]
    again = gltf.write_models(m.where("model_id = 'm.glb'")).first().content
    text, binary = gltf.split_glb(bytes(again))
    assert json.loads(text) == doc and binary[:118] == body
    uris = frame(spark, [("data:image/png;base64,AQID",), ("x/tex.jpg",)], "uri string")
    got = {r.uri: bytes(r.content) for r in gltf.resolve(uris, frame(spark, [("/a/tex.jpg", bytearray(b"j"))], "path string, content binary")).collect()}
    assert got == {"data:image/png;base64,AQID": b"\x01\x02\x03", "x/tex.jpg": b"j"}


def test_tileset(spark):
    doc = {"root": {"boundingVolume": {"sphere": [0, 0, 0, 10]}, "geometricError": 70, "refine": "ADD", "children": [{"boundingVolume": {"region": [0] * 6}, "geometricError": 0, "content": {"uri": "a.b3dm"}}, {"boundingVolume": {"sphere": [1, 0, 0, 1]}, "geometricError": 0}]}}
    t = tileset.read_tilesets(frame(spark, [("t.json", bytearray(json.dumps(doc).encode()))], "path string, content binary"))
    i = tiles3d.inherit(t)
    assert i.count() == 3 and {r.refine for r in i.collect()} == {"ADD"}
    for far, seen in ((100.0, 3), (1000.0, 1)):  # opens where height * 70 * u / distance reaches 10
        e = tiles3d.with_error(i, (0.0, 0.0, far), 20.0, 1.0)
        assert tiles3d.drawn(tiles3d.visited(e)).count() == seen


def test_tiff_meta():
    tags = [(256, 4, 1, 640), (257, 4, 1, 480), (258, 3, 1, 8), (277, 3, 1, 1)]
    data = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<2HII", *t) for t in tags) + b"\0" * 4
    assert raster.tiff_meta(data)[:4] == (640, 480, 1, 8)


def test_sql_functions(spark):
    scalar.register(spark)
    r = spark.sql("SELECT voxel_x(voxel_key(5, 7, 8, 9)) x, voxel_y(voxel_key(5, 7, 8, 9)) y, voxel_z(voxel_key(5, 7, 8, 9)) z, voxel_d(voxel_key(5, 7, 8, 9)) d, tile_of(2000D, 13) t").first()
    assert tuple(r) == (7, 8, 9, 5, 1)
    assert spark.sql("SELECT * FROM nbrs(1)").count() == 27


def test_streaming_counts(spark, tmp_path):
    spark.range(64).selectExpr("id / 64D x", "0.5D y", "0.5D z").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("x double, y double, z double").parquet(f"{tmp_path}/in")
    q = counts.voxel_counts(s, 2).writeStream.outputMode("complete").format("memory").queryName("vox_counts").start()
    try:
        q.processAllAvailable()
        assert sorted(r.n for r in spark.table("vox_counts").collect()) == [16] * 4
    finally:
        q.stop()


def test_streaming_counts_write_only_what_changes(spark, tmp_path):
    """A second batch touches one part of the table; the other parts' files stay, and a run again of the same batch changes nothing."""
    at = str(tmp_path)
    read = lambda: {(r.x, r.y, r.z): r.n for r in spark.read.parquet(f"{at}/out").collect()}
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/part=*/*.parquet")}
    spark.range(64).selectExpr("id / 64D x", "0.5D y", "0.5D z").write.parquet(f"{at}/in")
    points_ = spark.readStream.schema("x double, y double, z double").parquet(f"{at}/in")
    run = lambda: counts.keep_counts(points_, 4, f"{at}/out", f"{at}/state", 2).awaitTermination()
    run()
    assert read() == {(x, 8, 8): 4 for x in range(16)} and len({p.parent for p in files()}) == 4
    before = files()
    spark.range(3).selectExpr("0.01D x", "0.5D y", "0.5D z").write.mode("append").parquet(f"{at}/in")
    run()
    assert read() == {(x, 8, 8): 7 if x == 0 else 4 for x in range(16)}
    after = files()
    assert len({p.parent for p in before if p not in after}) == 1 and len({p.parent for p in after}) == 4
    run()
    assert files() == after
