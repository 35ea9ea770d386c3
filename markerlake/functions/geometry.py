"""Camera and plane geometry as column expressions.

Points and vectors are tuples of columns, matrices lists of rows: the few corners of a marker are written out as plain
columns, which stay inside generated code. Functions over point arrays of any length use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import lenses
from markerlake.sources.folders import importable

Vector = Sequence[Column]
Matrix = Sequence[Sequence[Column]]

BEHIND = -1e6  # coordinates of a point behind the camera
NEAR = 1e-6
ACTIVE = 1e-10  # a distortion coefficient of which is more counts


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(x / n for x in a)


def angle_of_incidence(target: Vector, eye: Vector, normal: Vector) -> Column:
    """Degrees between a surface's normal and the way to the eye; 0 if either has no length."""
    way = minus(eye, target)
    a, b = norm(way), norm(normal)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(way, normal) / (a * b)))
    return F.when((a < 1e-9) | (b < 1e-9), 0.0).otherwise(F.degrees(F.acos(cosine)))


def facing(target: Vector, eye: Vector, normal: Vector, least: float = 0.15) -> Column:
    """Whether a surface looks towards the eye; false at no distance."""
    way = minus(eye, target)
    n = norm(way)
    return F.when(n < 1e-6, False).otherwise(dot(unit(normal), way) / n > least)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return [[dot(row, column) for column in columns] for row in a]


def apply(m: Matrix, v: Vector) -> Vector:
    return tuple(dot(row, v) for row in m)


def transpose(m: Matrix) -> Matrix:
    return [list(x) for x in zip(*m, strict=True)]


def opencv_axes(m: Matrix) -> Matrix:
    """Columns 1 and 2 turned round: from a camera that looks along -z to one that looks along z, y down."""
    return [[x if j not in (1, 2) else -x for j, x in enumerate(row)] for row in m]


def world_normal(rotation: Matrix) -> Vector:
    """Unit normal of the local xy plane under a linear map with any scale: the third column of the cofactors."""
    x, y, z = transpose(rotation)
    n = cross(x, y)
    size = norm(n)
    flip = F.when(dot(n, z) < 0, -1.0).otherwise(1.0)
    plain = unit(z)
    return tuple(F.when(size < 1e-12, p).otherwise(flip * c / size) for c, p in zip(n, plain, strict=True))


def quaternion_of(m: Matrix) -> Vector:
    """Scalar-first quaternion of a rotation, by the largest of its four squares."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i
    s0, s1 = F.sqrt(trace + 1) * 2, F.sqrt(1 + a - e - i) * 2
    s2, s3 = F.sqrt(1 + e - a - i) * 2, F.sqrt(1 + i - a - e) * 2
    cases = [
        (trace > 0, (s0 / 4, (h - f) / s0, (c - g) / s0, (d - b) / s0)),
        ((a > e) & (a > i), ((h - f) / s1, s1 / 4, (b + d) / s1, (c + g) / s1)),
        (e > i, ((c - g) / s2, (b + d) / s2, s2 / 4, (f + h) / s2)),
    ]
    last = ((d - b) / s3, (c + g) / s3, (f + h) / s3, s3 / 4)
    return tuple(F.when(cases[0][0], cases[0][1][k]).when(cases[1][0], cases[1][1][k]).when(cases[2][0], cases[2][1][k]).otherwise(last[k]) for k in range(4))


def rotation_of(q: Vector) -> Matrix:
    """Rotation of a scalar-first unit quaternion."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def euler_rotation(rx: Column, ry: Column, rz: Column) -> Matrix:
    """Rz Ry Rx, radians."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a), F.sin(a)) for a in (rx, ry, rz))
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def relative_pose(camera: tuple[Matrix, Vector], target: tuple[Matrix, Vector]) -> tuple[Matrix, Vector]:
    """Rotation and place of a rigid target in the axes of a rigid camera."""
    back = transpose(camera[0])
    return multiply(back, target[0]), apply(back, minus(target[1], camera[1]))


def determinant(m: Matrix) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inverse(m: Matrix) -> Matrix:
    """Of a 3x3 matrix, by its cofactors."""
    rows = [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]
    d = determinant(m)
    return [[rows[j][i] / d for j in range(3)] for i in range(3)]


def rotation_between(a: Vector, b: Vector) -> Matrix:
    """The shortest rotation that takes the direction a to b; half a turn about a vector at right angles if they are opposite."""
    a, b = unit(a), unit(b)
    v, c = cross(a, b), dot(a, b)
    zero, one = F.lit(0.0), F.lit(1.0)
    skew = [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]
    opposite = 1 + c < 1e-12
    side = unit([F.when(F.abs(a[0]) < 0.9, p).otherwise(q) for p, q in zip(cross(a, (one, zero, zero)), cross(a, (zero, one, zero)), strict=True)])

    def entry(i: int, j: int) -> Column:
        turned = (c if i == j else zero) + skew[i][j] + v[i] * v[j] / F.when(opposite, 1.0).otherwise(1 + c)
        return F.when(opposite, 2 * side[i] * side[j] - (1.0 if i == j else 0.0)).otherwise(turned)

    return [[entry(i, j) for j in range(3)] for i in range(3)]


def look_at(eye: Vector, target: Vector, up: Vector | None = None) -> Matrix:
    """Rotation of a camera that looks along -z at a target; near the vertical, y serves as up."""
    up = up or (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    z = unit(minus(eye, target))
    near = F.abs(dot(z, up)) > 0.999
    side = [F.when(near, b).otherwise(a) for a, b in zip(cross(up, z), cross((F.lit(0.0), F.lit(1.0), F.lit(0.0)), z), strict=True)]
    x = unit(side)
    return transpose([x, cross(z, x), z])


def sun_vector(azimuth: Column, elevation: Column) -> Vector:
    a, e = F.radians(azimuth), F.radians(elevation)
    return (F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e))


# -- lenses -----------------------------------------------------------------------------------------------------------
def active(coefficients: Column) -> Column:
    return F.coalesce(F.exists(coefficients, lambda c: F.abs(c) > ACTIVE), F.lit(False))


def coefficient(coefficients: Column, i: int) -> Column:
    return F.coalesce(F.get(coefficients, F.lit(i)), F.lit(0.0))


def brown_conrady(x: Column, y: Column, coefficients: Column) -> Vector:
    k1, k2, p1, p2, k3 = (coefficient(coefficients, i) for i in range(5))
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y)


def kannala_brandt(x: Column, y: Column, coefficients: Column) -> Vector:
    k = [coefficient(coefficients, i) for i in range(4)]
    r = F.sqrt(x * x + y * y)
    t = F.atan(r)
    t2 = t * t
    bent = t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = F.when(r <= 1e-8, 1.0).otherwise(bent / r)
    return (x * scale, y * scale)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, where no column of its own can hold it: inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distort_point(x: Column, y: Column, model: Column, coefficients: Column) -> Column:
    """[x, y] of `distort`, for lambdas: each step is worked out once."""

    def plain(p: Column) -> Column:
        k1, k2, p1, p2, k3 = (coefficient(coefficients, i) for i in range(5))
        r2, u, v = p["r2"], p["x"], p["y"]
        return let(1 + r2 * (k1 + r2 * (k2 + r2 * k3)), lambda radial: F.array(u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v))

    def wide(p: Column) -> Column:
        k = [coefficient(coefficients, i) for i in range(4)]
        r = F.sqrt(p["r2"])
        bent = let(F.atan(r), lambda t: let(t * t, lambda t2: t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))))
        return let(F.when(r <= 1e-8, 1.0).otherwise(bent / F.when(r <= 1e-8, 1.0).otherwise(r)), lambda scale: F.array(p["x"] * scale, p["y"] * scale))

    point = let(F.struct(x.alias("x"), y.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] * p["x"] + p["y"] * p["y"]).alias("r2")))
    return let(point, lambda p: F.when(~active(coefficients), F.array(p["x"], p["y"])).when(model == "kannala_brandt", wide(p)).otherwise(plain(p)))


def distort(x: Column, y: Column, model: Column, coefficients: Column) -> Vector:
    """Normalised image coordinates through the lens; any model but kannala_brandt counts as Brown-Conrady."""
    wide, plain = kannala_brandt(x, y, coefficients), brown_conrady(x, y, coefficients)
    on = active(coefficients)
    return tuple(F.when(~on, v).when(model == "kannala_brandt", a).otherwise(b) for v, a, b in zip((x, y), wide, plain, strict=True))


def lens_of(model: Column, coefficients: Column) -> list[Column]:
    """What the functions of `lenses` take of a lens: whether it is kannala_brandt, whether it counts, five coefficients."""
    importable(SparkSession.active())
    return [F.coalesce(model == "kannala_brandt", F.lit(False)), active(coefficients), *(coefficient(coefficients, i).cast("double") for i in range(5))]


def undistort(x: Column, y: Column, model: Column, coefficients: Column) -> Column:
    """struct(x, y, theta, residual): the inverse of `distort` by Newton's steps, the angle from the axis, and how far the
    result, distorted again, is from what was asked. Beyond a lens's largest radius there is no inverse: the residual tells.
    """
    return lenses.inverse(x.cast("double"), y.cast("double"), *lens_of(model, coefficients))


EDGE_SAMPLES = 32


def edge_rays(k: Matrix, width: Column, height: Column, model: Column, coefficients: Column, samples: int = EDGE_SAMPLES) -> Column:
    """`undistort` of points along the four edges of a frame, from the first pixel to the last."""
    numbers = [c.cast("double") for c in (k[0][0], k[0][2], k[1][1], k[1][2], width, height)]
    return lenses.edges_inverse(*numbers, F.lit(samples), *lens_of(model, coefficients))


def overscan(rays: Column, k: Matrix, width: Column, height: Column) -> Column:
    """struct(width, height) of the frame without distortion, even and no smaller than the target's, that holds all its
    rays; the principal point lies in its middle, the focal lengths stay."""
    far = lambda name, f: 2 * F.ceil(F.array_max(F.transform(rays, lambda r: F.abs(r[name]))) * f + 1)
    return F.struct(F.greatest(far("x", k[0][0]), width).cast("int").alias("width"), F.greatest(far("y", k[1][1]), height).cast("int").alias("height"))


def spherical_overscan(rays: Column, k: Matrix, margin_degrees: float = 2.0) -> Column:
    """struct(fov in radians, size) of a square equidistant frame that holds all rays and a margin."""
    theta = F.array_max(F.transform(rays, lambda r: r["theta"])) + F.radians(F.lit(margin_degrees))
    return F.struct((2 * theta).alias("fov"), (2 * F.ceil(k[0][0] * theta)).cast("int").alias("size"))


def project(point: Vector, k: Matrix, model: Column | None = None, coefficients: Column | None = None) -> Vector:
    """Pixel of a point in camera axes; BEHIND for points that are not before the camera."""
    x, y, z = point
    safe = F.when(z <= NEAR, 1.0).otherwise(z)
    u, v = (x / safe, y / safe) if coefficients is None else distort(x / safe, y / safe, model, coefficients)
    w = dot(k[2], (u, v, F.lit(1.0)))
    return tuple(F.when(z <= NEAR, BEHIND).otherwise(dot(k[i], (u, v, F.lit(1.0))) / w) for i in (0, 1))


def place(rotation: Matrix, translation: Vector, local: Vector) -> Vector:
    return tuple(a + b for a, b in zip(apply(rotation, local), translation, strict=True))


def axis_tips(rotation: Matrix, translation: Vector, half: Column, k: Matrix, model: Column, coefficients: Column) -> Column:
    """Pixels of a pose's origin and its three axis tips; null if any lies behind."""
    zero = F.lit(0.0)
    ends = [(zero, zero, zero), (half, zero, zero), (zero, half, zero), (zero, zero, half)]
    points = [place(rotation, translation, e) for e in ends]
    ahead = reduce(lambda a, b: a & b, [p[2] > NEAR for p in points])
    return F.when(ahead, F.array(*(F.array(*project(p, k, model, coefficients)) for p in points)))


# -- resolution -------------------------------------------------------------------------------------------------------
def pixels_per_module(focal: Column, size: Column, depth: Column, grid: Column) -> Column:
    return F.when((depth <= 0) | (grid <= 0), 0.0).otherwise(focal * size / (depth * grid))


def distance_for_ppm(focal: Column, size: Column, ppm: Column, grid: Column) -> Column:
    return F.when((ppm <= 0) | (grid <= 0), 100.0).otherwise(focal * size / (ppm * grid))


def focal_from_fov(width: Column, fov: Column, height: Column | None = None, model: Column | None = None) -> Column:
    """Focal length in pixels: the width spans the field of view, or of a kannala_brandt lens the diagonal its angle."""
    plain = width / (2 * F.tan(F.radians(fov) / 2))
    if model is None:
        return plain
    return F.when(model == "kannala_brandt", F.sqrt(width * width + height * height) / 2 / F.radians(fov / 2)).otherwise(plain)


def k_matrix(width: Column, height: Column, explicit: Column, fx: Column, fy: Column, focal_mm: Column, sensor_mm: Column, fov: Column) -> Column:
    """3x3 intrinsics from what is known first: the matrix, fx and fy, a focal length with the sensor's width, the field of view."""
    from_sensor, from_fov = focal_mm * width / sensor_mm, focal_from_fov(width, fov)
    f, g = F.coalesce(fx, from_sensor, from_fov), F.coalesce(fy, fx, from_sensor, from_fov)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.coalesce(explicit, F.array(F.array(f, zero, width / 2), F.array(zero, g, height / 2), F.array(zero, zero, one)))


def rescale_k(k: Column, sx: Column, sy: Column) -> Column:
    row = lambda i, s: F.transform(F.get(k, F.lit(i)), lambda x: x * s)
    return F.array(row(0, sx), row(1, sy), F.get(k, F.lit(2)))


# -- plane figures ----------------------------------------------------------------------------------------------------
def signed_area(points: Sequence[Vector]) -> Column:
    """Shoelace area of few points, positive for clockwise order with y down."""
    return total([a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]], strict=True)]) / 2


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of points, signed; 0 for fewer than three."""
    n = F.size(points)

    def term(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, F.pmod(i + 1, n))
        return F.get(a, F.lit(0)) * F.get(b, F.lit(1)) - F.get(b, F.lit(0)) * F.get(a, F.lit(1))

    area = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2
    return F.when(n < 3, 0.0).otherwise(area)


def clockwise(points: Column) -> Column:
    """At least three points with positive area, y down."""
    return (F.size(points) >= 3) & (polygon_area(points) > 1e-6)


def box_iou(a: Vector, b: Vector) -> Column:
    """Intersection over union of boxes (x, y, width, height); 0 where both are empty."""
    over = [F.greatest(F.lit(0.0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i])) for i in (0, 1)]
    both = over[0] * over[1]
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def ray_at_plane(origin: Vector, end: Vector, height: Column) -> Column:
    """(x, y) where the way between two points crosses a height; null unless strictly between them."""
    rise = end[2] - origin[2]
    t = (height - origin[2]) / F.when(F.abs(rise) < 1e-12, None).otherwise(rise)
    return F.when((t > 0) & (t < 1), F.array(*(origin[i] + t * (end[i] - origin[i]) for i in (0, 1))))


def largest_gap(angles: Column) -> Column:
    """Largest gap between neighbours on the circle, radians; the whole circle for one angle, null for none."""
    turn = 6.283185307179586
    ordered = F.array_sort(F.transform(angles, lambda a: F.pmod(a, F.lit(turn))))
    n = F.size(ordered)
    gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, F.get(ordered, F.lit(0)) + turn - F.get(ordered, i)).otherwise(F.get(ordered, i + 1) - F.get(ordered, i)))
    return F.when(n > 0, F.array_max(gaps))
