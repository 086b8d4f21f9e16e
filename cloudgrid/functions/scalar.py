"""Column expressions and their SQL registrations; every one is plain Catalyst, so it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Chart units per metre, and the level that tiles are cut at.
CHART, BASE_LEVEL = 1e7, 13
#: Bits of one axis in a packed voxel key; depths 0 to 15 fit.
AXIS_BITS, MAX_DEPTH = 19, 15


def cell(v: Column, size: int | float) -> Column:
    """Index of the cell of an axis cut into ``size`` cells (floor, not truncation)."""
    return F.floor(v * float(size)).cast("int")


def voxel_key(d, x, y, z) -> Column:
    """Packed key: depth, z, y, x from the highest bits down."""
    c = [F.col(k).cast("long") if isinstance(k, str) else k.cast("long") for k in (d, z, y, x)]
    return F.shiftleft(c[0], 59).bitwiseOR(F.shiftleft(c[1], 2 * AXIS_BITS)).bitwiseOR(F.shiftleft(c[2], AXIS_BITS)).bitwiseOR(c[3])


def voxel_part(key: Column, part: str) -> Column:
    """d, x, y or z of a packed key."""
    mask = F.lit((1 << AXIS_BITS) - 1).cast("long")
    if part == "d":
        return F.shiftright(key, 59).cast("int")
    return F.shiftright(key, {"x": 0, "y": AXIS_BITS, "z": 2 * AXIS_BITS}[part]).bitwiseAND(mask).cast("int")


def interleaved(*axes) -> Column:
    """Interleaved bits of whole numbers, the first axis lowest: of two, 31 bits each, of three 21 (two's complement below 0).

    A cell's key moved right by one bit for each axis is its parent's.
    """
    n = len(axes)
    bits = 63 // n

    def spread(c) -> Column:
        v = (F.col(c) if isinstance(c, str) else c).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        for half in (16, 8, 4, 2, 1):  # groups of twice that many bits part in two, so that groups lie n times their size apart
            kept = sum(1 << (k % half + k // half * half * n) for k in range(bits))
            v = v.bitwiseOR(F.shiftleft(v, (n - 1) * half)).bitwiseAND(F.lit(kept))
        return v

    out = spread(axes[0])
    for k, c in enumerate(axes[1:], 1):
        out = out.bitwiseOR(F.shiftleft(spread(c), k))
    return out


def morton(x, y, z) -> Column:
    """The key of a cell of an octree; see ``interleaved``."""
    return interleaved(x, y, z)


def vertex_signature(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(z.cast("long"), 32).bitwiseOR(F.shiftleft(y.cast("long"), 16)).bitwiseOR(x.cast("long"))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def matmul4(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 matrices held as arrays."""
    at = lambda m, r, c: F.element_at(m, r * 4 + c + 1)
    return F.array(*[sum((at(a, r, k) * at(b, k, c) for k in range(1, 4)), at(a, r, 0) * at(b, 0, c)) for r in range(4) for c in range(4)])


def transform3(m: Column, v: Column) -> Column:
    """Affine image of a 3-vector: rotation and scale, then translation."""
    return F.array(*[F.element_at(m, r * 4 + 1) * F.element_at(v, 1) + F.element_at(m, r * 4 + 2) * F.element_at(v, 2) + F.element_at(m, r * 4 + 3) * F.element_at(v, 3) + F.element_at(m, r * 4 + 4) for r in range(3)])


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Nine entries of a unit quaternion's rotation, by rows."""
    one, two = F.lit(1.0), F.lit(2.0)
    return [one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w), two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w), two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y)]


def trs(t: list[Column], q: list[Column], s: list[Column], legacy: bool = False) -> Column:
    """Translation, rotation and scale as one 4x4 matrix; legacy: the scale after the rotation."""
    r = quaternion_matrix(*q)
    rows = []
    for i in range(3):
        rows += [r[3 * i + j] * (s[i] if legacy else s[j]) for j in range(3)] + [t[i]]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def screen_error(distance: Column, geometric: Column, height: Column | float, u: Column | float) -> Column:
    """Screen-space error of a tile: pixels that its geometric error covers."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return lit(height) * geometric * lit(u) / distance


EARTH = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / EARTH)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / EARTH)) - F.lit(1.5707963267948966))


def int_log2(v: Column) -> Column:
    """H-log2: the position of the highest set bit of a positive whole number; 0 for 1 and below."""
    return F.when(v > 1, F.length(F.bin(v.cast("long"))) - 1).otherwise(0).cast("int")


#: Fixed values of glTF: bytes and names of component types, and components of data types.
COMPONENT_BYTES = {5120: 1, 5121: 1, 5122: 2, 5123: 2, 5125: 4, 5126: 4}
COMPONENT_NAMES = {5120: "BYTE", 5121: "UNSIGNED_BYTE", 5122: "SHORT", 5123: "UNSIGNED_SHORT", 5125: "UNSIGNED_INT", 5126: "FLOAT"}
DATA_TYPE_COUNTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def _from(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def component_bytes(kind: Column) -> Column:
    """H-enum."""
    return _from(COMPONENT_BYTES, kind).cast("int")


def component_name(kind: Column) -> Column:
    """H-enum."""
    return _from(COMPONENT_NAMES, kind).cast("string")


def data_type_count(name: Column) -> Column:
    """H-enum: components of an element; null for what is no data type."""
    return _from(DATA_TYPE_COUNTS, name).cast("int")


def _at(m: Column, r: int, c: int) -> Column:
    return F.element_at(m, r * 4 + c + 1)


def inverse_transpose(m: Column) -> Column:
    """The inverse of a row-major 4x4 matrix, transposed (what normals are turned by): its cofactors over its determinant; null if that is 0."""

    def minor(m, r, c):
        i, j = [k for k in range(4) if k != r], [k for k in range(4) if k != c]
        e = lambda a, b: _at(m, i[a], j[b])
        det = e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))
        return det if (r + c) % 2 == 0 else -det

    # bound to names by lambdas, so that each cofactor is one expression
    cofactors = F.transform(F.array(m), lambda x: F.array(*[minor(x, r, c) for r in range(4) for c in range(4)]))
    both = F.zip_with(F.array(m), cofactors, lambda x, k: F.struct(k.alias("k"), sum((_at(x, 0, c) * _at(k, 0, c) for c in range(1, 4)), _at(x, 0, 0) * _at(k, 0, 0)).alias("det")))
    return F.element_at(F.transform(both, lambda b: F.when(b["det"] != 0, F.transform(b["k"], lambda v: v / b["det"]))), 1)


def _row(*v) -> list[Column]:
    return [x if isinstance(x, Column) else F.lit(float(x)) for x in v]


def projection(hfov: Column, vfov: Column, near: Column | float, far: Column | float) -> Column:
    """The 4x4 projection (z forward) of a camera by its fields of view in degrees."""
    n, f = _row(near, far)
    u, v = (F.lit(1.0) / F.tan(F.radians(a * 0.5)) for a in (hfov, vfov))
    return F.array(*_row(u, 0, 0, 0, 0, v, 0, 0, 0, 0, (f + n) / (f - n), F.lit(-2.0) * f * n / (f - n), 0, 0, 1, 0))


def view_of_pose(rotation: Column, position: Column) -> Column:
    """The 4x4 view of a camera by the nine entries of its rotation and its position: (R | -R t)."""
    r = [F.element_at(rotation, k + 1) for k in range(9)]
    t = [F.element_at(position, k + 1) for k in range(3)]
    rows = []
    for i in range(3):
        rows += [*r[3 * i : 3 * i + 3], -(r[3 * i] * t[0] + r[3 * i + 1] * t[1] + r[3 * i + 2] * t[2])]
    return F.array(*rows, *_row(0, 0, 0, 1))


def pose_of_view(view: Column) -> tuple[Column, Column]:
    """(rotation from camera to world, position) of a view: (R^T, -R^T t)."""
    turn = F.array(*[_at(view, j, i) for i in range(3) for j in range(3)])
    at = F.array(*[-(_at(view, 0, i) * _at(view, 0, 3) + _at(view, 1, i) * _at(view, 1, 3) + _at(view, 2, i) * _at(view, 2, 3)) for i in range(3)])
    return turn, at


def look_at(eye: list[Column], center: list[Column], up: list[Column]) -> Column:
    """The 4x4 look-at matrix with z forward; the translation is that of the eye, turned."""
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def unit(v):
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [x / n for x in v]

    z = unit([c - e for c, e in zip(center, eye, strict=True)])
    x = unit(cross(z, up))
    y = cross(x, z)
    rows = []
    for r in (x, y, z):
        rows += [*r, r[0] * eye[0] + r[1] * eye[1] + r[2] * eye[2]]
    return F.array(*rows, *_row(0, 0, 0, 1))


def frustum(left: Column, right: Column, bottom: Column, top: Column, near: Column, far: Column) -> Column:
    """The 4x4 matrix of a frustum with z forward."""
    two = F.lit(2.0)
    return F.array(*_row(two * near / (right - left), 0, (right + left) / (right - left), 0, 0, two * near / (top - bottom), (top + bottom) / (top - bottom), 0, 0, 0, (far + near) / (far - near), -two * far * near / (far - near), 0, 0, 1, 0))


#: WGS 84's flattening, the scale on a UTM zone's meridian, its false easting and northing.
FLATTENING, UTM_SCALE, FALSE_EAST, FALSE_NORTH = 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
#: radius of the sphere of the same meridian length, and Krueger's series (forward and back) to the third order of the third flattening
UTM_RADIUS = EARTH / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
UTM_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
UTM_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
UTM_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
UTM_E = 2 * _N**0.5 / (1 + _N)


def utm_zone(lon: Column) -> Column:
    """Zone of a longitude in degrees, 1 to 60."""
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres, by Krueger's series; southern northings count from the false one."""
    d, s = F.radians(lon - (zone * 6.0 - 183.0)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * UTM_E) * UTM_E)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(t * t + 1.0))
    e, n = eta, xi
    for j, a in enumerate(UTM_FORWARD, 1):
        e = e + F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * a
        n = n + F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * a
    return e * (UTM_SCALE * UTM_RADIUS) + FALSE_EAST, n * (UTM_SCALE * UTM_RADIUS) + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def utm_back(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of a place in a zone."""
    xi = (north - F.when(south, FALSE_NORTH).otherwise(0.0)) / (UTM_SCALE * UTM_RADIUS)
    eta = (east - FALSE_EAST) / (UTM_SCALE * UTM_RADIUS)
    x, e = xi, eta
    for j, b in enumerate(UTM_BACK, 1):
        x = x - F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * b
        e = e - F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * b
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(UTM_LATITUDE, 1):
        lat = lat + F.sin(chi * (2.0 * j)) * d
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + zone * 6.0 - 183.0, F.degrees(lat)


_MAT = "transform(sequence(0, 15), i -> aggregate(sequence(0, 3), 0D, (s, k) -> s + element_at(a, cast(i div 4 * 4 + k + 1 AS INT)) * element_at(b, k * 4 + i % 4 + 1)))"
_VEC = "transform(sequence(0, 2), r -> element_at(m, r * 4 + 1) * element_at(v, 1) + element_at(m, r * 4 + 2) * element_at(v, 2) + element_at(m, r * 4 + 3) * element_at(v, 3) + element_at(m, r * 4 + 4))"


def _turn(x: str, y: str, z: str, w: str) -> str:
    """The nine entries of a quaternion's rotation as SQL."""
    return f"array(1 - 2 * ({y} * {y} + {z} * {z}), 2 * ({x} * {y} - {z} * {w}), 2 * ({x} * {z} + {y} * {w}), 2 * ({x} * {y} + {z} * {w}), 1 - 2 * ({x} * {x} + {z} * {z}), 2 * ({y} * {z} - {x} * {w}), 2 * ({x} * {z} - {y} * {w}), 2 * ({y} * {z} + {x} * {w}), 1 - 2 * ({x} * {x} + {y} * {y}))"


_Q = [f"element_at(q, {k})" for k in (1, 2, 3, 4)]
_SQL = {
    "voxel_key": ("d INT, x BIGINT, y BIGINT, z BIGINT", "BIGINT", "shiftleft(cast(d as bigint), 59) | shiftleft(z, 38) | shiftleft(y, 19) | x"),
    "voxel_d": ("k BIGINT", "INT", "cast(shiftright(k, 59) as int)"),
    "voxel_x": ("k BIGINT", "INT", "cast(k & 524287 as int)"),
    "voxel_y": ("k BIGINT", "INT", "cast(shiftright(k, 19) & 524287 as int)"),
    "voxel_z": ("k BIGINT", "INT", "cast(shiftright(k, 38) & 524287 as int)"),
    "vert_sig": ("x BIGINT, y BIGINT, z BIGINT", "BIGINT", "shiftleft(z, 32) | shiftleft(y, 16) | x"),
    "tile_of": ("v DOUBLE, lvl INT", "INT", "cast(floor(v / 1e7 * shiftleft(1, lvl)) as int)"),
    "tile_edge": ("lvl INT", "DOUBLE", "1e7 / shiftleft(1, lvl)"),
    "sse": ("h DOUBLE, geo DOUBLE, u DOUBLE, dist DOUBLE", "DOUBLE", "h * geo * u / dist"),
    "int_log2": ("v BIGINT", "INT", "CASE WHEN v > 1 THEN length(bin(v)) - 1 ELSE 0 END"),
    "mat_mul": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", _MAT),
    "mat_vec": ("m ARRAY<DOUBLE>, v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", _VEC),
    "quat_matrix": ("x DOUBLE, y DOUBLE, z DOUBLE, w DOUBLE", "ARRAY<DOUBLE>", _turn("x", "y", "z", "w")),
    "trs_matrix": ("t ARRAY<DOUBLE>, q ARRAY<DOUBLE>, s ARRAY<DOUBLE>", "ARRAY<DOUBLE>", f"transform(sequence(0, 15), i -> CASE WHEN i > 11 THEN cast(i = 15 AS DOUBLE) WHEN i % 4 = 3 THEN element_at(t, cast(i div 4 + 1 AS INT)) ELSE element_at({_turn(*_Q)}, cast(i div 4 * 3 + i % 4 + 1 AS INT)) * element_at(s, i % 4 + 1) END)"),
    "mercator_x": ("lon DOUBLE", "DOUBLE", "radians(lon) * 6378137.0D"),
    "mercator_y": ("lat DOUBLE", "DOUBLE", "ln(tan(0.7853981633974483D + radians(lat) / 2)) * 6378137.0D"),
    "mercator_lon": ("x DOUBLE", "DOUBLE", "degrees(x / 6378137.0D)"),
    "mercator_lat": ("y DOUBLE", "DOUBLE", "degrees(2 * atan(exp(y / 6378137.0D)) - 1.5707963267948966D)"),
}


def register(spark: SparkSession) -> None:
    """SQL scalar functions, and the table function ``nbrs(r)`` of cube offsets; Spark inlines all of them."""
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nbrs(r INT) RETURNS TABLE(dx INT, dy INT, dz INT) RETURN SELECT a.id - r, b.id - r, c.id - r FROM explode(sequence(0, 2 * r)) a(id), explode(sequence(0, 2 * r)) b(id), explode(sequence(0, 2 * r)) c(id)")
