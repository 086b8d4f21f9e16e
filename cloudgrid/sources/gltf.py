"""glTF, GLB and b3dm models as tables, one for each entity, and back to GLB.

Models come as rows (path, content) of Spark's ``binaryFile``; the containers are split in Python, the JSON is parsed by Spark.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
GLB_MAGIC, JSON_CHUNK, BIN_CHUNK, B3DM_MAGIC = 0x46546C67, 0x4E4F534A, 0x004E4942, 0x6D643362
B3DM_HEADER = 28

_PRIMITIVE = "struct<attributes:map<string,int>,indices:int,material:int,mode:int>"
_SCHEMA = (
    "nodes array<struct<mesh:int,matrix:array<double>,translation:array<double>,rotation:array<double>,scale:array<double>,children:array<int>>>,"
    "buffers array<struct<byteLength:int,uri:string>>,"
    "bufferViews array<struct<buffer:int,byteLength:int,byteOffset:int,byteStride:int,target:int>>,"
    "accessors array<struct<bufferView:int,byteOffset:int,componentType:int,type:string,count:int,max:array<double>,min:array<double>,normalized:boolean>>,"
    f"meshes array<struct<name:string,primitives:array<{_PRIMITIVE}>>>,"
    "scenes array<struct<name:string,nodes:array<int>>>,"
    "images array<struct<uri:string,mimeType:string,bufferView:int>>,"
    "textures array<struct<sampler:int,source:int>>,"
    "samplers array<struct<minFilter:int,magFilter:int,wrapS:int,wrapT:int>>,"
    "materials array<struct<name:string,pbrMetallicRoughness:struct<baseColorTexture:struct<index:int,texCoord:int>,baseColorFactor:array<double>,metallicFactor:double,roughnessFactor:double>,emissiveFactor:array<double>>>"
)
#: entity -> (columns as SQL over the entry e, with the defaults of absent members)
_COLUMNS = {
    "nodes": "coalesce(e.mesh, -1) mesh, e.matrix xform, e.translation, e.rotation, e.scale, coalesce(e.children, array()) children",
    "buffers": "e.byteLength byte_length, e.uri uri",
    "buffer_views": "e.buffer buffer, e.byteLength byte_length, coalesce(e.byteOffset, 0) byte_offset, coalesce(e.byteStride, 0) byte_stride, coalesce(e.target, 0) target",
    "accessors": "coalesce(e.bufferView, -1) buffer_view, coalesce(e.byteOffset, 0) byte_offset, e.componentType component_type, e.type data_type, e.count count, e.max, e.min, coalesce(e.normalized, false) normalized",
    "meshes": "e.name name",
    "scenes": "e.name name, coalesce(e.nodes, array()) base_nodes",
    "images": "e.uri uri, e.mimeType mime_type, coalesce(e.bufferView, -1) buffer_view",
    "textures": "coalesce(e.sampler, -1) sampler, coalesce(e.source, -1) source",
    "samplers": "coalesce(e.minFilter, 9729) min_filter, coalesce(e.magFilter, 9729) mag_filter, coalesce(e.wrapS, 10497) wrap_s, coalesce(e.wrapT, 10497) wrap_t",
    "materials": "e.name name, coalesce(e.pbrMetallicRoughness.baseColorTexture.index, -1) base_color_texture, coalesce(e.pbrMetallicRoughness.baseColorTexture.texCoord, 1) tex_coord, coalesce(e.pbrMetallicRoughness.baseColorFactor, array(1D, 1D, 1D, 1D)) base_color_factor, coalesce(e.pbrMetallicRoughness.metallicFactor, 1D) metallic, coalesce(e.pbrMetallicRoughness.roughnessFactor, 1D) roughness, coalesce(e.emissiveFactor, array(0D, 0D, 0D)) emissive",
}
_MEMBER = {"buffer_views": "bufferViews"}


def split_glb(data: bytes) -> tuple[str, bytes | None]:
    """(JSON text, binary chunk)."""
    magic, version, _ = struct.unpack_from("<3I", data, 0)
    if magic != GLB_MAGIC or version != 2:
        raise ValueError("no GLB of version 2")
    at, text, binary = 12, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from("<2I", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == JSON_CHUNK and text is None:
            text = body.decode()
        elif kind == BIN_CHUNK and binary is None:
            binary = bytes(body)
        at += 8 + n
    if text is None:
        raise ValueError("GLB without a JSON chunk")
    return text, binary


def split_b3dm(data: bytes) -> bytes:
    """The GLB after header, feature table and batch table."""
    magic, _, length, fj, fb, bj, bb = struct.unpack_from("<7I", data, 0)
    if magic != B3DM_MAGIC:
        raise ValueError("no b3dm")
    return data[B3DM_HEADER + fj + fb + bj + bb : length]


def join_glb(text: str, binary: bytes | None) -> bytes:
    """Chunks padded to four bytes, JSON with spaces and binary with zeros."""
    j = text.encode()
    j += b" " * (-len(j) % 4)
    out = struct.pack("<2I", len(j), JSON_CHUNK) + j
    if binary:
        b = binary + b"\0" * (-len(binary) % 4)
        out += struct.pack("<2I", len(b), BIN_CHUNK) + b
    return struct.pack("<3I", GLB_MAGIC, 2, 12 + len(out)) + out


def read_models(files: DataFrame) -> DataFrame:
    """(model_id, json, bin) from (path, content), by the path's ending."""

    def split(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                end = path.lower().rpartition(".")[2]
                data = split_b3dm(bytes(content)) if end == "b3dm" else bytes(content)
                text, binary = (data.decode(), None) if end == "gltf" else split_glb(data)
                rows.append((path, text, binary))
            yield pd.DataFrame(rows, columns=["model_id", "json", "bin"])

    return files.select("path", "content").mapInPandas(split, "model_id string, json string, bin binary")


def entities(models: DataFrame) -> dict[str, DataFrame]:
    """The entity tables, each keyed (model_id, idx), defaults filled in."""
    m = models.select("model_id", F.from_json("json", _SCHEMA).alias("j"))
    out = {}
    for name, cols in _COLUMNS.items():
        e = m.select("model_id", F.posexplode(f"j.{_MEMBER.get(name, name)}").alias("idx", "e"))
        out[name] = e.selectExpr("model_id", "idx", *_split(cols))
    p = m.select("model_id", F.posexplode("j.meshes").alias("mesh", "m")).select("model_id", "mesh", F.posexplode("m.primitives").alias("idx", "e"))
    out["primitives"] = p.selectExpr("model_id", "mesh", "idx", "e.attributes attribs", "coalesce(e.indices, -1) indices", "coalesce(e.material, -1) material", "coalesce(e.mode, 4) mode")
    return out


def _split(cols: str) -> list[str]:
    """SQL expressions at the commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(cols + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(cols[last:i].strip())
            last = i + 1
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_id, entity, n)."""
    parts = [t.groupBy("model_id").agg(F.count("*").alias("n")).withColumn("entity", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model_id", "entity", "n")


def attributes(tables: dict[str, DataFrame]) -> DataFrame:
    """Every primitive's attributes with their accessor and buffer view."""
    p = tables["primitives"].select("model_id", "mesh", F.col("idx").alias("primitive"), F.explode("attribs").alias("attribute", "accessor"))
    a = tables["accessors"].select("model_id", F.col("idx").alias("accessor"), "buffer_view", F.col("byte_offset").alias("in_view"), "component_type", "data_type", "count")
    v = tables["buffer_views"].select("model_id", F.col("idx").alias("buffer_view"), "buffer", "byte_length", "byte_offset", "byte_stride")
    return p.join(a, ["model_id", "accessor"]).join(v, ["model_id", "buffer_view"])


def texture_images(tables: dict[str, DataFrame]) -> DataFrame:
    """Every material's image, by its texture's source."""
    m = tables["materials"].select("model_id", F.col("idx").alias("material"), F.col("base_color_texture").alias("texture"))
    t = tables["textures"].select("model_id", F.col("idx").alias("texture"), F.col("source").alias("image"))
    i = tables["images"].select("model_id", F.col("idx").alias("image"), "uri", "mime_type", "buffer_view")
    return m.join(t, ["model_id", "texture"]).join(i, ["model_id", "image"])


def view_bytes(models: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The bytes of every buffer view of the binary chunk."""
    v = tables["buffer_views"].where("buffer = 0").join(models.select("model_id", "bin"), "model_id")
    return v.select("model_id", "idx", F.expr("substring(bin, byte_offset + 1, byte_length)").alias("data"))


def resolve(uris: DataFrame, files: DataFrame) -> DataFrame:
    """Content of (uri): base64 data URIs are decoded, others are looked up among (path, content) by their end."""
    inline = uris.where("uri like 'data:%'").select("uri", F.unbase64(F.substring_index("uri", ",", -1)).alias("content"))
    named = uris.where("uri not like 'data:%'").join(files.select(F.substring_index("path", "/", -1).alias("name"), "content"), F.substring_index("uri", "/", -1) == F.col("name"))
    return inline.unionByName(named.select("uri", "content"))


def write_models(models: DataFrame) -> DataFrame:
    """(model_id, content) as GLB from (model_id, json, bin)."""

    def pack(batches):
        for pdf in batches:
            body = [join_glb(json.dumps(json.loads(j), separators=(",", ":")), None if b is None else bytes(b)) for j, b in zip(pdf.json, pdf.bin, strict=True)]
            yield pd.DataFrame({"model_id": pdf.model_id, "content": body})

    return models.select("model_id", "json", "bin").mapInPandas(pack, "model_id string, content binary")


#: entity -> members of its JSON entry, as SQL; null members are left out
_MEMBERS = {
    "nodes": "CASE WHEN mesh >= 0 THEN mesh END mesh, xform matrix, CASE WHEN size(children) > 0 THEN children END children",
    "buffers": "byte_length byteLength, uri",
    "buffer_views": "buffer, byte_length byteLength, byte_offset byteOffset, CASE WHEN byte_stride > 0 THEN byte_stride END byteStride, CASE WHEN target > 0 THEN target END target",
    "accessors": "buffer_view bufferView, byte_offset byteOffset, component_type componentType, data_type type, count, max, min",
    "meshes": "name, primitives",
    "scenes": "name, base_nodes nodes",
    "images": "uri, mime_type mimeType, CASE WHEN buffer_view >= 0 THEN buffer_view END bufferView",
    "textures": "CASE WHEN sampler >= 0 THEN sampler END sampler, CASE WHEN source >= 0 THEN source END source",
    "samplers": "min_filter minFilter, mag_filter magFilter, wrap_s wrapS, wrap_t wrapT",
    "materials": "name, named_struct('baseColorTexture', CASE WHEN base_color_texture >= 0 THEN named_struct('index', base_color_texture) END, 'baseColorFactor', base_color_factor, 'metallicFactor', metallic, 'roughnessFactor', roughness) pbrMetallicRoughness, emissive emissiveFactor",
}


def from_tables(tables: dict[str, DataFrame], data: DataFrame | None = None) -> DataFrame:
    """(model_id, json, bin) from the entity tables of ``entities`` (those that are given) and the bytes (model_id, bin) of buffer 0.

    Every table is grouped by model; a model is one document, so its entries are one group.
    """
    tables = dict(tables)
    if "meshes" in tables and "primitives" in tables:
        p = tables["primitives"].selectExpr("model_id", "mesh", "idx", "named_struct('attributes', attribs, 'indices', CASE WHEN indices >= 0 THEN indices END, 'material', CASE WHEN material >= 0 THEN material END, 'mode', mode) p")
        p = p.groupBy("model_id", F.col("mesh").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json("p").alias("j")))), lambda x: x["j"]).alias("j"))
        p = p.select("model_id", "idx", F.from_json(F.concat(F.lit("["), F.concat_ws(",", "j"), F.lit("]")), f"array<{_PRIMITIVE}>").alias("primitives"))
        tables["meshes"] = tables["meshes"].join(p, ["model_id", "idx"], "left")
    parts = None
    for name, cols in _MEMBERS.items():
        if name not in tables:
            continue
        entry = tables[name].select("model_id", "idx", F.to_json(F.struct(*[F.expr(c) for c in _split(cols)])).alias("j"))
        whole = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("idx", "j"))), lambda x: x["j"]))
        part = entry.groupBy("model_id").agg(F.concat(F.lit(f'"{_MEMBER.get(name, name)}":['), whole, F.lit("]")).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy("model_id").agg(F.concat(F.lit('{"asset":{"version":"2.0"},'), F.array_join(F.array_sort(F.collect_list("part")), ","), F.lit("}")).alias("json"))
    return out.withColumn("bin", F.lit(None).cast("binary")) if data is None else out.join(data.select("model_id", "bin"), "model_id", "left")


def as_b3dm(models: DataFrame) -> DataFrame:
    """(model_id, content) as b3dm from (model_id, content) as GLB: a header with empty tables before it (A14's inverse)."""

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"model_id": pdf.model_id, "content": [struct.pack("<7I", B3DM_MAGIC, 1, B3DM_HEADER + len(c), 0, 0, 0, 0) + bytes(c) for c in pdf.content]})

    return models.select("model_id", "content").mapInPandas(pack, "model_id string, content binary")
