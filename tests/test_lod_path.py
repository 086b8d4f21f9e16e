"""Tiles along a camera path against the states kept from frame to frame."""

import random

from pyspark.sql import functions as F

from cloudgrid.operators import tiles3d


class Tile:
    def __init__(self, name, x, error, depth):
        self.name, self.x, self.error, self.depth, self.state, self.children = name, x, error, depth, "closed", []

    def large(self, eye):
        return 20 * self.error * 1.5 / abs(self.x - eye) >= 10

    def show(self):
        self.state = "open"
        for c in self.children:
            c.state = "frontier"

    def hide(self):
        for c in self.children:
            if c.state == "open":
                c.hide()
            c.state = "closed"
        self.state = "frontier"

    def frame(self, eye, root=False):
        if self.state == "closed" and root or self.state == "frontier":
            if self.large(eye):
                self.show()
        elif self.state == "open":
            if not self.large(eye):
                self.hide()
            else:
                for c in self.children:
                    c.frame(eye)

    def states(self):
        yield self.name, self.depth, self.state
        for c in self.children:
            yield from c.states()


def test_states_are_those_kept_from_frame_to_frame(spark):
    r = random.Random(3)
    rows, roots = [], []

    def grow(parent, name, depth, error):
        t = Tile(name, r.uniform(0, 20), error, depth)
        rows.append((0 if name.startswith("a") else 1, name, parent, depth, error, ("sphere", [t.x, 0.0, 0.0, 1.0])))
        if depth < 5:
            t.children = [grow(name, f"{name}{k}", depth + 1, error * r.uniform(0.4, 0.9)) for k in range(r.choice([0, 2, 3]) if depth else 3)]
        return t

    roots = [grow(None, "a", 0, 8.0), grow(None, "b", 0, 6.0)]
    path = [30.0]
    for _ in range(60):
        path.append(path[-1] + r.uniform(-9, 8))
    tiles = spark.createDataFrame(rows, "tileset int, tile_id string, parent_id string, depth int, geo_error double, bv struct<type:string,vals:array<double>>")
    frames = spark.createDataFrame([(s, k, x, 0.0, 0.0) for s in (0, 1) for k, x in enumerate(path)], "tileset int, frame long, ex double, ey double, ez double")
    want, changes, was = set(), set(), set()
    for k, eye in enumerate(path):
        now = set()
        for t in roots:
            t.frame(eye, True)
            for name, depth, state in t.states():
                if state != "closed":
                    want.add((k, name, depth, state == "open"))
                if state == "open":
                    now.add(name)
        changes |= {(k, n, True) for n in now - was} | {(k, n, False) for n in was - now}
        was = now
    got = tiles3d.along(tiles, frames, 20.0, 1.5)
    assert {(x.frame, x.tile_id, x.depth, x.open) for x in got.collect()} == want
    assert got.count() == len(want) and {d for _, _, d, o in want if o} >= {0, 1, 2, 3}
    assert {(x.frame, x.tile_id, x.opened) for x in tiles3d.transitions(got).collect()} == changes
    far = frames.withColumn("ex", F.col("ex") + 1e6)
    assert tiles3d.along(tiles, far, 20.0, 1.5).count() == 0  # a root that never opens is on no frontier
