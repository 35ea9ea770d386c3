"""Inverse lenses and dense outlines on Arrow batches: steps that repeat until they are near, for all rows of a batch at
once. In expressions each step would be evaluated node by node, as lambdas aren't compiled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

NEWTON = 24  # steps of the inverse lens: each doubles the right digits once it is near
STILL = 1e-15  # share of a value by which a step that changes nothing any more may still move it
ROWS = 1024  # rows worked on at once, whatever a batch holds
RAY = StructType([StructField(n, DoubleType()) for n in ("x", "y", "theta", "residual")])


def numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(float, copy=False)


def flags(a: pa.Array) -> np.ndarray:
    return a.fill_null(False).to_numpy(zero_copy_only=False).astype(bool, copy=False)


def in_parts(f: Callable[..., pa.Array], *args: pa.Array) -> pa.Array:
    parts = [f(*(a.slice(i, ROWS) for a in args)) for i in range(0, max(len(args[0]), 1), ROWS)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def bent(x: np.ndarray, y: np.ndarray, wide: np.ndarray, on: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """geometry.distort of points, each with its lens: the model, whether any coefficient counts, five coefficients."""
    u, v = x.copy(), y.copy()
    for rows, f in ((on & ~wide, bent_plain), (on & wide, bent_wide)):
        if rows.all():
            return f(x, y, c)
        if rows.any():
            u[rows], v[rows] = f(x[rows], y[rows], c[:, rows])
    return u, v


def bent_plain(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k1, k2, p1, p2, k3 = c
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def bent_wide(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.sqrt(x * x + y * y)
    t = np.arctan(r)
    t2 = t * t
    flat = r <= 1e-8
    scale = np.where(flat, 1.0, t * (1 + t2 * (c[0] + t2 * (c[1] + t2 * (c[2] + t2 * c[3])))) / np.where(flat, 1.0, r))
    return x * scale, y * scale


def newton(step: Callable[[np.ndarray, np.ndarray], np.ndarray], at: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Newton's steps of all columns of `at` side by side; columns that no longer move drop out."""
    out, todo = at.copy(), np.arange(at.shape[1])
    for _ in range(NEWTON):
        new = step(at, given)
        out[:, todo] = new
        moves = (np.abs(new - at) > STILL * np.abs(new) + 1e-17).any(axis=0)
        if not moves.any():
            break
        todo, at, given = todo[moves], new[:, moves], given[:, moves]
    return out


def step_plain(at: np.ndarray, given: np.ndarray) -> np.ndarray:
    u, v = at
    k1, k2, p1, p2, k3, xd, yd = given
    r2 = u * u + v * v
    radial, slope = 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), k1 + r2 * (2 * k2 + 3 * r2 * k3)
    a, d = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u) - xd, v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v - yd
    uu, vv = radial + 2 * u * u * slope + 2 * p1 * v + 6 * p2 * u, radial + 2 * v * v * slope + 6 * p1 * v + 2 * p2 * u
    uv = 2 * u * v * slope + 2 * p1 * u + 2 * p2 * v
    det = uu * vv - uv * uv
    safe = np.where(np.abs(det) < 1e-12, 1.0, det)
    return np.stack([u - (vv * a - uv * d) / safe, v - (uu * d - uv * a) / safe])


def step_wide(at: np.ndarray, given: np.ndarray) -> np.ndarray:
    t2 = at[0] * at[0]
    c, r = given[:4], given[4]
    f = at[0] * (1 + t2 * (c[0] + t2 * (c[1] + t2 * (c[2] + t2 * c[3])))) - r
    slope = 1 + t2 * (3 * c[0] + t2 * (5 * c[1] + t2 * (7 * c[2] + t2 * 9 * c[3])))
    return (at[0] - f / np.where(np.abs(slope) < 1e-12, 1.0, slope))[None]


def straight(x: np.ndarray, y: np.ndarray, wide: np.ndarray, on: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The fields of RAY for points behind the lens."""
    with np.errstate(all="ignore"):
        u, v = x.copy(), y.copy()
        rows = np.flatnonzero(on & ~wide)
        if len(rows):
            u[rows], v[rows] = newton(step_plain, np.stack([x[rows], y[rows]]), np.concatenate([c[:, rows], x[None, rows], y[None, rows]]))
        rows = np.flatnonzero(on & wide)
        if len(rows):
            r = np.sqrt(x[rows] * x[rows] + y[rows] * y[rows])
            t = newton(step_wide, np.fmin(r, 1.5)[None], np.concatenate([c[:4, rows], r[None]]))[0]
            flat = r <= 1e-8
            scale = np.where(flat, 1.0, np.tan(t) / np.where(flat, 1.0, r))
            u[rows], v[rows] = x[rows] * scale, y[rows] * scale
        a, b = bent(u, v, wide, on, c)
        return [u, v, np.arctan(np.sqrt(u * u + v * v)), np.maximum(np.abs(a - x), np.abs(b - y))]


def rays(x: np.ndarray, y: np.ndarray, none: np.ndarray, wide: np.ndarray, on: np.ndarray, c: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(f, mask=none) for f in straight(x, y, wide, on, c)], ["x", "y", "theta", "residual"])


@arrow_udf(RAY)
def inverse(x: pa.Array, y: pa.Array, wide: pa.Array, on: pa.Array, k1: pa.Array, k2: pa.Array, k3: pa.Array, k4: pa.Array, k5: pa.Array) -> pa.Array:
    """A ray for each point; null fields where a coordinate is null."""

    def part(x: pa.Array, y: pa.Array, wide: pa.Array, on: pa.Array, *c: pa.Array) -> pa.Array:
        none = pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
        return rays(numbers(x), numbers(y), none, flags(wide), flags(on), np.stack([numbers(a) for a in c]))

    return in_parts(part, x, y, wide, on, k1, k2, k3, k4, k5)


@arrow_udf(ArrayType(RAY))
def edges_inverse(fx: pa.Array, cx: pa.Array, fy: pa.Array, cy: pa.Array, width: pa.Array, height: pa.Array, samples: pa.Array, wide: pa.Array, on: pa.Array, k1: pa.Array, k2: pa.Array, k3: pa.Array, k4: pa.Array, k5: pa.Array) -> pa.Array:
    """Rays of `samples` points along each edge of a frame: the upper, the lower, the left and the right one."""

    def part(fx: pa.Array, cx: pa.Array, fy: pa.Array, cy: pa.Array, width: pa.Array, height: pa.Array, samples: pa.Array, wide: pa.Array, on: pa.Array, *c: pa.Array) -> pa.Array:
        n, rows = samples[0].as_py() if len(samples) else 2, len(fx)
        share = np.arange(n) / (n - 1)
        w, h = ((numbers(a) - 1)[:, None] for a in (width, height))
        along = [(w * share, 0 * h), (w * share, h), (0 * w, h * share), (w, h * share)]
        shape = (rows, n)
        u, v = (np.concatenate([np.broadcast_to(e[i], shape) for e in along], axis=1) for i in range(2))
        x, y = ((p - numbers(m)[:, None]) / numbers(f)[:, None] for p, m, f in ((u, cx, fx), (v, cy, fy)))
        each = lambda a: np.repeat(a, 4 * n, axis=-1)
        x, y = x.ravel(), y.ravel()
        found = rays(x, y, np.isnan(x) | np.isnan(y), each(flags(wide)), each(flags(on)), each(np.stack([numbers(a) for a in c])))
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 4 * n), found)

    return in_parts(part, fx, cx, fy, cy, width, height, samples, wide, on, k1, k2, k3, k4, k5)


@arrow_udf(ArrayType(ArrayType(DoubleType())))
def dense(points: pa.Array, fx: pa.Array, cx: pa.Array, fy: pa.Array, cy: pa.Array, most: pa.Array, depth: pa.Array, wide: pa.Array, on: pa.Array, k1: pa.Array, k2: pa.Array, k3: pa.Array, k4: pa.Array, k5: pa.Array) -> pa.Array:
    """Pixels of polygons whose edges are halved, at most `depth` times, until the middle of each is within `most` of its
    chord's; the first point again at the end. Null for fewer than three points.

    The edges of all rows are halved side by side; an edge's end is kept with its place, out of 2 to the power of depth.
    """

    def part(points: pa.Array, fx: pa.Array, cx: pa.Array, fy: pa.Array, cy: pa.Array, most: pa.Array, depth: pa.Array, wide: pa.Array, on: pa.Array, *c: pa.Array) -> pa.Array:
        size = pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = size < 3
        corner, start = points.flatten(), np.concatenate([[0], np.cumsum(size)])
        p = np.stack([numbers(corner.field(n)) for n in ("x", "y", "z")])
        row = np.repeat(np.arange(len(size)), size)
        after = np.arange(len(row)) + 1
        after[start[1:][size > 0] - 1] = start[:-1][size > 0]
        lens, k = np.stack([numbers(a) for a in c]), [numbers(a) for a in (fx, cx, fy, cy)]
        wide, on, most = flags(wide), flags(on), numbers(most)

        def pixels(p: np.ndarray, row: np.ndarray) -> np.ndarray:
            u, v = bent(p[0] / p[2], p[1] / p[2], wide[row], on[row], lens[:, row])
            return np.stack([u * k[0][row] + k[1][row], v * k[2][row] + k[3][row]])

        with np.errstate(all="ignore"):
            u = pixels(p, row)
            edge, step = np.arange(len(row)), depth[0].as_py() if len(depth) else 0
            edge = edge[~none[row]]
            a, b, ua, ub, end = p[:, edge], p[:, after[edge]], u[:, edge], u[:, after[edge]], np.full(len(edge), 1 << step, np.int64)
            done = []
            while step and len(edge):
                step -= 1
                m = a + 0.5 * (b - a)
                w = pixels(m, row[edge])
                off = w - (ua + ub) / 2
                near = off[0] * off[0] + off[1] * off[1] <= most[row[edge]] ** 2
                done.append((edge[near], end[near], ub[:, near]))
                far = ~near
                edge, a, b, ua, ub, m, w, end = edge[far], a[:, far], b[:, far], ua[:, far], ub[:, far], m[:, far], w[:, far], end[far]
                edge, end = np.concatenate([edge, edge]), np.concatenate([end - (1 << step), end])
                a, b, ua, ub = np.concatenate([a, m], axis=1), np.concatenate([m, b], axis=1), np.concatenate([ua, w], axis=1), np.concatenate([w, ub], axis=1)
            done.append((edge, end, ub))
        first = start[:-1][~none]  # each row's first point goes before its edges' ends
        edge, end, pixel = (np.concatenate(x, axis=-1) for x in zip(*done, (first, np.full(len(first), -1), u[:, first]), strict=True))
        order = np.lexsort((end, edge))
        count = np.bincount(row[edge], minlength=len(size)) if len(edge) else np.zeros(len(size), np.int64)
        pairs = pa.FixedSizeListArray.from_arrays(pa.array(pixel[:, order].T.ravel()), 2).cast(pa.list_(pa.float64()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pairs, mask=pa.array(none))

    return in_parts(part, points, fx, cx, fy, cy, most, depth, wide, on, k1, k2, k3, k4, k5)
