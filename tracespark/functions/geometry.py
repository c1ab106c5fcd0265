"""Camera and rigid-body algebra as column expressions: everything stays inside code generation.

A pose is sixteen doubles, row-major, world to camera. Nulls in any input give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # added to the depth before dividing; points behind a camera give mirrored pixels


def rigid(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The upper 3x4 part of m applied to a point."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))  # type: ignore[return-value]


def project(fx: Column, fy: Column, cx: Column, cy: Column, m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Pixel coordinates and undivided depth of a world point."""
    a, b, c = rigid(m, x, y, z)
    d = c + F.lit(EPS)
    return (fx * a + cx * c) / d, (fy * b + cy * c) / d, c


def unproject(fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column, d: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel at a depth; integer pixels are pixel centres."""
    return (u - cx) / fx * d, (v - cy) / fy * d, d


def inverse_rigid(m: list[Column]) -> list[Column]:
    """Inverse of a rigid pose: transposed rotation, rotated negative translation."""
    r = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    t = [m[3], m[7], m[11]]
    out: list[Column] = []
    for i in range(3):
        out += [r[0][i], r[1][i], r[2][i], -(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])]
    return [*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def compose(a: list[Column], b: list[Column]) -> list[Column]:
    """Matrix product a b of two poses."""
    return [sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)]


def pairwise_transform(target: list[Column], source: list[Column]) -> list[Column]:
    """The pose that takes source to target: target times the inverse of source."""
    return compose(target, inverse_rigid(source))


def distance_to_depth(d: Column, fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column) -> Column:
    """Depth along the axis of a point at distance d along the ray through a pixel."""
    a, b = (u - cx) / fx, (v - cy) / fy
    return d / F.sqrt(a * a + b * b + 1)


def depth_to_distance(z: Column, fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column) -> Column:
    a, b = (u - cx) / fx, (v - cy) / fy
    return z * F.sqrt(a * a + b * b + 1)


def log_depth(fx: Column, fy: Column, d: Column, least: float = 1e-6) -> Column:
    """Logarithmic depth scaled by the mean focal length."""
    return F.sqrt(fx * fy) * F.ln(F.greatest(d, F.lit(least)))


def fov(focal: Column, size: Column) -> Column:
    return 2 * F.atan(size / 2 / focal)


def focal(angle: Column, size: Column) -> Column:
    return size / 2 / F.tan(angle / 2)


def rescale_centred(value: Column, old: Column, new: Column) -> Column:
    """Intrinsic under a resize that keeps pixel centres: (new - 1) / (old - 1)."""
    return value * (new - 1) / (old - 1)


def rescale_plain(value: Column, old: Column, new: Column) -> Column:
    return value * new / old


def quaternion(r: list[Column]) -> list[Column]:
    """(w, x, y, z) of a rotation given as nine columns, by the branch with the largest pivot."""
    m = [r[0:3], r[3:6], r[6:9]]
    tr = m[0][0] + m[1][1] + m[2][2]
    s0, s1 = F.sqrt(F.greatest(tr + 1, F.lit(1e-12))) * 2, F.sqrt(F.greatest(1 + m[0][0] - m[1][1] - m[2][2], F.lit(1e-12))) * 2
    s2, s3 = F.sqrt(F.greatest(1 + m[1][1] - m[0][0] - m[2][2], F.lit(1e-12))) * 2, F.sqrt(F.greatest(1 + m[2][2] - m[0][0] - m[1][1], F.lit(1e-12))) * 2
    q = [
        [s0 / 4, (m[2][1] - m[1][2]) / s0, (m[0][2] - m[2][0]) / s0, (m[1][0] - m[0][1]) / s0],
        [(m[2][1] - m[1][2]) / s1, s1 / 4, (m[0][1] + m[1][0]) / s1, (m[0][2] + m[2][0]) / s1],
        [(m[0][2] - m[2][0]) / s2, (m[0][1] + m[1][0]) / s2, s2 / 4, (m[1][2] + m[2][1]) / s2],
        [(m[1][0] - m[0][1]) / s3, (m[0][2] + m[2][0]) / s3, (m[1][2] + m[2][1]) / s3, s3 / 4],
    ]
    pick = lambda k: F.when(tr > 0, q[0][k]).when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), q[1][k]).when(m[1][1] > m[2][2], q[2][k]).otherwise(q[3][k])
    return [pick(k) for k in range(4)]


def rotation(q: list[Column]) -> list[Column]:
    """Nine columns of the rotation of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation along the shorter arc; straight where the quaternions nearly agree."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    th = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * th) / F.sin(F.when(near, F.lit(1.0)).otherwise(th)))
    wb = F.when(near, t).otherwise(F.sin(t * th) / F.sin(F.when(near, F.lit(1.0)).otherwise(th)))
    raw = [wa * p + wb * sign * q for p, q in zip(a, b)]
    norm = F.sqrt(sum((x * x for x in raw[1:]), raw[0] * raw[0]))
    return [x / norm for x in raw]


def rotation_angle(trace: Column) -> Column:
    """Angle of a rotation with the given trace."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
