"""Tilesets (tileset.json) as rows of tiles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "tileset string, tile_id string, parent_id string, depth int, geo_error double, refine string, uri string, bv struct<type:string,vals:array<double>>, xform array<double>"


def walk(name: str, doc: dict):
    """One row for each tile, parents first; ids are paths of child numbers."""
    stack = [(doc["root"], "0", None, 0)]
    while stack:
        t, tid, parent, depth = stack.pop()
        kind, vals = next(iter(t.get("boundingVolume", {"region": []}).items()))
        content = t.get("content") or {}
        yield (name, tid, parent, depth, t.get("geometricError"), t.get("refine"), content.get("uri") or content.get("url"), {"type": kind, "vals": [float(v) for v in vals]}, [float(v) for v in t["transform"]] if "transform" in t else None)
        stack += [(c, f"{tid}.{i}", tid, depth + 1) for i, c in reversed(list(enumerate(t.get("children", []))))]


def read_tilesets(files: DataFrame) -> DataFrame:
    """Tiles of (path, content) rows.  A tileset is one document of any depth, so it is walked in one piece."""

    def parse(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf.path, pdf.content, strict=True) for r in walk(p, json.loads(bytes(c)))]
            out = pd.DataFrame(rows, columns=["tileset", "tile_id", "parent_id", "depth", "geo_error", "refine", "uri", "bv", "xform"])
            out["depth"] = out["depth"].astype("int32")
            yield out

    return files.select("path", "content").mapInPandas(parse, SCHEMA)
