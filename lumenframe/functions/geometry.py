"""Column expressions of pinhole cameras, similarities and robust weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def working_size(width: Column, height: Column, max_edge: int) -> tuple[Column, Column]:
    """Dimensions shrunk to ``max_edge``, even, never enlarged."""
    factor = F.lit(float(max_edge)) / F.greatest(width, height)

    def one(side: Column) -> Column:
        shrunk = F.greatest(F.lit(2).cast("bigint"), F.expr("1").cast("bigint") * (F.floor(F.floor(side * factor) / 2) * 2))
        return F.when(F.greatest(width, height) <= max_edge, side).otherwise(shrunk).cast("bigint")

    return one(width), one(height)


def canvas_scale(width: Column, height: Column, canvas_w: int, canvas_h: int) -> tuple[Column, Column, Column]:
    """Scale to fit a canvas without enlarging, and the rounded dimensions of at least 1."""
    scale = F.least(F.lit(1.0), canvas_w / width, canvas_h / height)
    return scale, F.greatest(F.lit(1), F.round(width * scale).cast("int")), F.greatest(F.lit(1), F.round(height * scale).cast("int"))


def half_pixel(p: Column, to: Column, of: Column) -> Column:
    """A coordinate of one raster in another, pixel centres at halves."""
    return (p + 0.5) * to / of - 0.5


def camera_point(x: Column, y: Column, z: Column, r: list[Column] | None, c: list[Column]) -> tuple[Column, Column, Column]:
    """World to camera: transpose of the camera-to-world rotation on (point - centre); no rotation means identity."""
    d = [x - c[0], y - c[1], z - c[2]]
    if r is None:
        return tuple(d)
    return tuple(r[j] * d[0] + r[3 + j] * d[1] + r[6 + j] * d[2] for j in range(3))


def reprojection_error(p: tuple[Column, Column, Column], fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column) -> Column:
    """Pixel distance of a camera-frame point; infinite at or behind the camera and where not finite."""
    x, y, z = p
    depth = F.when(z > 0, z)
    error = F.sqrt(F.pow(fx * x / depth + cx - u, 2) + F.pow(fy * y / depth + cy - v, 2))
    return F.when((z > 0) & ~F.isnan(error) & error.isNotNull(), error).otherwise(F.lit(INF))


def back_project(u: Column, v: Column, d: Column, fx: Column, fy: Column, cx: Column, cy: Column, r: list[Column] | None, c: list[Column]) -> tuple[Column, ...]:
    ray = [(u - cx) / fx * d, (v - cy) / fy * d, d]
    if r is None:
        return tuple(ray[i] + c[i] for i in range(3))
    return tuple(r[3 * i] * ray[0] + r[3 * i + 1] * ray[1] + r[3 * i + 2] * ray[2] + c[i] for i in range(3))


def sim3(scale: Column, r: list[Column], t: list[Column], p: list[Column]) -> tuple[Column, ...]:
    return tuple(scale * (r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2]) + t[i] for i in range(3))


def inverse_pose(r: list[Column], t: list[Column]) -> tuple[list[Column], list[Column]]:
    """World-to-camera (r, t) as camera-to-world rotation and centre, and back."""
    back = [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]
    return back, [-(back[3 * i] * t[0] + back[3 * i + 1] * t[1] + back[3 * i + 2] * t[2]) for i in range(3)]


def rotation_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two rotations, radians."""
    trace = a[0] * b[0]
    for i in range(1, 9):
        trace = trace + a[i] * b[i]
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2)))


def pixel_key(p: Column) -> Column:
    """Equal for measurements of the same pixel: the 1e-4 grid, halves to even."""
    return F.rint(p * 10000).cast("bigint")


def huber_weight(r: Column, delta: float) -> Column:
    """Factor on a residual of length ``r``: sqrt(q (2 - q)) with q = delta / r beyond ``delta``."""
    q = delta / F.when(r > delta, r)
    return F.when(r > delta, F.sqrt(q * (2 - q))).otherwise(F.lit(1.0))


def tls_weight(e: Column, mu: float, c: float) -> Column:
    """Truncated-least-squares weight of a squared error under graduated non-convexity."""
    c2 = c * c
    return F.when(e <= mu / (mu + 1) * c2, 1.0).when(e >= (mu + 1) / mu * c2, 0.0).otherwise(F.sqrt(c2 * mu * (mu + 1) / F.when(e > 0, e)) - mu)


def fundamental_error(f: list[float], ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Larger of the two squared point-to-epipolar-line distances."""
    lb = [f[0] * ax + f[1] * ay + f[2], f[3] * ax + f[4] * ay + f[5], f[6] * ax + f[7] * ay + f[8]]
    la = [f[0] * bx + f[3] * by + f[6], f[1] * bx + f[4] * by + f[7], f[2] * bx + f[5] * by + f[8]]
    n = bx * lb[0] + by * lb[1] + lb[2]
    return F.greatest(n * n / (lb[0] * lb[0] + lb[1] * lb[1]), n * n / (la[0] * la[0] + la[1] * la[1]))


def homography_error(h: list[float], ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared one-way transfer distance."""
    z = h[6] * ax + h[7] * ay + h[8]
    x, y = (h[0] * ax + h[1] * ay + h[2]) / z, (h[3] * ax + h[4] * ay + h[5]) / z
    return (x - bx) * (x - bx) + (y - by) * (y - by)


def grid_cell(x: Column, y: Column, w: float, h: float, cells: int = 4) -> Column:
    """Number of the cell of a cells-by-cells raster, clamped at the far edge."""
    cx = F.least(F.lit(cells - 1), F.floor(x * cells / w).cast("int"))
    cy = F.least(F.lit(cells - 1), F.floor(y * cells / h).cast("int"))
    return cy * cells + cx
