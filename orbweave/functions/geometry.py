"""Plane and space geometry as Column expressions: no Python in the hot path.

Division by zero is null here (not an error, not infinity) unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list  # of Columns or column names, one for each axis


def _c(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def _v(v: Vector) -> list[Column]:
    return [_c(x) for x in v]


def div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def dot(a: Vector, b: Vector) -> Column:
    out = F.lit(0.0)
    for x, y in zip(_v(a), _v(b), strict=True):
        out = out + x * y
    return out


def sub(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(_v(a), _v(b), strict=True)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross2(a: Vector, b: Vector) -> Column:
    (ax, ay), (bx, by) = _v(a), _v(b)
    return ax * by - ay * bx


def cross3(a: Vector, b: Vector) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = _v(a), _v(b)
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def log_odds(p: Column | str) -> Column:
    return F.log(_c(p) / (F.lit(1.0) - _c(p)))


def probability(odds: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(odds)))


# boxes: (low, high) vectors


def box(centre: Vector, half: Vector) -> tuple[list[Column], list[Column]]:
    return [c - h for c, h in zip(_v(centre), _v(half), strict=True)], [c + h for c, h in zip(_v(centre), _v(half), strict=True)]


def box_centre(low: Vector, high: Vector) -> list[Column]:
    return [(a + b) / 2 for a, b in zip(_v(low), _v(high), strict=True)]


def box_half(low: Vector, high: Vector) -> list[Column]:
    return [(b - a) / 2 for a, b in zip(_v(low), _v(high), strict=True)]


def pad_box(low: Vector, high: Vector, by: Vector) -> tuple[list[Column], list[Column]]:
    return [a - p for a, p in zip(_v(low), _v(by), strict=True)], [b + p for b, p in zip(_v(high), _v(by), strict=True)]


def box_intersection(low: Vector, high: Vector, low2: Vector, high2: Vector) -> tuple[list[Column], list[Column]]:
    return [F.greatest(a, b) for a, b in zip(_v(low), _v(low2), strict=True)], [F.least(a, b) for a, b in zip(_v(high), _v(high2), strict=True)]


def box_valid(low: Vector, high: Vector) -> Column:
    out = F.lit(True)
    for a, b in zip(_v(low), _v(high), strict=True):
        out = out & (a <= b)
    return out


def in_box(p: Vector, low: Vector, high: Vector) -> Column:
    out = F.lit(True)
    for x, a, b in zip(_v(p), _v(low), _v(high), strict=True):
        out = out & (x >= a) & (x <= b)
    return out


def box_volume(low: Vector, high: Vector) -> Column:
    out = F.lit(1.0)
    for a, b in zip(_v(low), _v(high), strict=True):
        out = out * (b - a)
    return out


# lines


def point_segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """Distance of a point to a segment of any dimension; a segment without length is its point."""
    d, w = sub(b, a), sub(p, a)
    t = F.coalesce(div(dot(w, d), dot(d, d)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return norm([x - t * y for x, y in zip(w, d, strict=True)])


def line_line(a1: Vector, a2: Vector, b1: Vector, b2: Vector) -> tuple[Column, Column]:
    """Parameters on both lines of where they cross; null if parallel."""
    d, e, w = sub(a2, a1), sub(b2, b1), sub(b1, a1)
    n = cross2(d, e)
    return div(cross2(w, e), n), div(cross2(w, d), n)


def line_line_closest3(a1: Vector, a2: Vector, b1: Vector, b2: Vector) -> tuple[Column, Column, Column]:
    """Parameters of the closest points of two lines in space, and their distance; null if parallel."""
    d, e, w = sub(a2, a1), sub(b2, b1), sub(a1, b1)
    dd, de, ee, dw, ew = dot(d, d), dot(d, e), dot(e, e), dot(d, w), dot(e, w)
    n = dd * ee - de * de
    s, t = div(de * ew - ee * dw, n), div(dd * ew - de * dw, n)
    gap = [x + s * y - t * z for x, y, z in zip(w, d, e, strict=True)]
    return s, t, norm(gap)


def line_line_intersect3(a1: Vector, a2: Vector, b1: Vector, b2: Vector, tolerance: float = 1e-9) -> Column:
    """Whether two segments in space meet."""
    s, t, gap = line_line_closest3(a1, a2, b1, b2)
    return F.coalesce((gap <= tolerance) & s.between(0, 1) & t.between(0, 1), F.lit(False))


def ray_segment(p: Vector, direction: Vector, a: Vector, b: Vector) -> tuple[Column, Column]:
    """(weight of a at the crossing: 1 at a, 0 at b; signed distance along the unit direction); null if parallel."""
    e, w = sub(a, b), sub(p, b)
    n = cross2(direction, e)
    return div(-cross2(w, direction), n), div(cross2(e, w), n)


def ray_box(p: Vector, direction: Vector, low: Vector, high: Vector) -> tuple[Column, Column, Column]:
    """(hit, near, far) by slabs; a ray along a slab is inside it or misses. From inside, near is behind (negative)."""
    near, far, ok = [], [], F.lit(True)
    for x, v, a, b in zip(_v(p), _v(direction), _v(low), _v(high), strict=True):
        t1, t2 = div(a - x, v), div(b - x, v)
        near.append(F.when(v == 0, F.lit(-math.inf)).otherwise(F.least(t1, t2)))
        far.append(F.when(v == 0, F.lit(math.inf)).otherwise(F.greatest(t1, t2)))
        ok = ok & ((v != 0) | ((x >= a) & (x <= b)))
    n, f = F.greatest(*near), F.least(*far)
    return ok & (n <= f), n, f


def line_ellipsoid(p1: Vector, p2: Vector, radii: Vector) -> tuple[Column, Column]:
    """Roots in the line's parameter (0 at p1, 1 at p2), smaller first, for an axis-aligned ellipse or ellipsoid at the origin; null if it misses."""
    p, d = [x / r for x, r in zip(_v(p1), _v(radii), strict=True)], [x / r for x, r in zip(sub(p2, p1), _v(radii), strict=True)]
    a, b, c = dot(d, d), dot(p, d) * 2, dot(p, p) - 1
    disc = b * b - a * c * 4
    root = F.when((disc >= 0) & (a != 0), F.sqrt(F.when(disc >= 0, disc)))
    return div(-b - root, a * 2), div(-b + root, a * 2)


def winding_term(p: Vector, a: Vector, b: Vector) -> Column:
    """What an edge adds to a point's winding number: 1 up left of it, -1 down right of it."""
    (_, y), (_, ay), (_, by) = _v(p), _v(a), _v(b)
    left = cross2(sub(b, a), sub(p, a))
    return F.when((ay <= y) & (by > y) & (left > 0), 1).when((ay > y) & (by <= y) & (left < 0), -1).otherwise(0)


# primitives: inside and boundary tests, transforms


def in_ellipsoid(p: Vector, centre: Vector, radii: Vector) -> Column:
    d = sub(p, centre)
    return dot([x / r for x, r in zip(d, _v(radii), strict=True)], [x / r for x, r in zip(d, _v(radii), strict=True)]) <= 1


def on_ellipsoid(p: Vector, centre: Vector, radii: Vector) -> Column:
    d = [x / r for x, r in zip(sub(p, centre), _v(radii), strict=True)]
    return dot(d, d) == 1


def rotate2(p: Vector, angle: Column | float) -> list[Column]:
    x, y = _v(p)
    c, s = F.cos(_c(angle)), F.sin(_c(angle))
    return [x * c - y * s, x * s + y * c]


def to_frame2(p: Vector, origin: Vector, angle: Column | float) -> list[Column]:
    """World to frame."""
    return rotate2(sub(p, origin), -_c(angle))


def to_world2(p: Vector, origin: Vector, angle: Column | float) -> list[Column]:
    return [a + b for a, b in zip(rotate2(p, angle), _v(origin), strict=True)]


def in_rectangle(p: Vector, centre: Vector, half: Vector, angle: Column | float) -> Column:
    q = to_frame2(p, centre, angle)
    return (F.abs(q[0]) <= _c(half[0])) & (F.abs(q[1]) <= _c(half[1]))


def on_segment(p: Vector, a: Vector, b: Vector) -> Column:
    return (cross2(sub(b, a), sub(p, a)) == 0) & in_box(p, [F.least(x, y) for x, y in zip(_v(a), _v(b), strict=True)], [F.greatest(x, y) for x, y in zip(_v(a), _v(b), strict=True)])


def on_line(p: Vector, a: Vector, b: Vector) -> Column:
    return cross2(sub(b, a), sub(p, a)) == 0


def on_ray(p: Vector, origin: Vector, direction: Vector) -> Column:
    w = sub(p, origin)
    return (cross2(direction, w) == 0) & (dot(direction, w) >= 0)


def clip_segment_box(a: Vector, b: Vector, low: Vector, high: Vector) -> tuple[Column, Column]:
    """Parameters in [0, 1] between which a segment is in a box; null if it never is."""
    hit, near, far = ray_box(a, sub(b, a), low, high)
    n, f = F.greatest(near, F.lit(0.0)), F.least(far, F.lit(1.0))
    ok = hit & (n <= f)
    return F.when(ok, n), F.when(ok, f)


#: What the parameter of each kind of line may be.
SPANS = {"line": (-math.inf, math.inf), "ray": (0.0, math.inf), "segment": (0.0, 1.0)}


def intersect2(kind_a: str, a1: Vector, a2: Vector, kind_b: str, b1: Vector, b2: Vector) -> tuple[Column, Column, Column]:
    """(hit, x, y) of two of line, ray (from the first point through the second) and segment."""
    s, t = line_line(a1, a2, b1, b2)
    hit = F.coalesce(s.between(*SPANS[kind_a]) & t.between(*SPANS[kind_b]), F.lit(False))
    x, y = [p + s * d for p, d in zip(_v(a1), sub(a2, a1), strict=True)]
    return hit, F.when(hit, x), F.when(hit, y)


def intersect_rectangle(kind: str, p1: Vector, p2: Vector, centre: Vector, half: Vector, angle: Column | float = 0.0) -> tuple[Column, Column]:
    """Parameters between which a line, ray or segment is in a (turned) rectangle; null if never."""
    q1, q2 = to_frame2(p1, centre, angle), to_frame2(p2, centre, angle)
    low, high = [-_c(h) for h in half], _v(half)
    hit, near, far = ray_box(q1, sub(q2, q1), low, high)
    n, f = F.greatest(near, F.lit(SPANS[kind][0])), F.least(far, F.lit(SPANS[kind][1]))
    return F.when(hit & (n <= f), n), F.when(hit & (n <= f), f)


def intersect_ellipse(kind: str, p1: Vector, p2: Vector, centre: Vector, radii: Vector, angle: Column | float = 0.0) -> tuple[Column, Column]:
    """Parameters at which a line, ray or segment crosses a (turned) ellipse; null where it doesn't."""
    roots = line_ellipsoid(to_frame2(p1, centre, angle), to_frame2(p2, centre, angle), radii)
    return tuple(F.when(r.between(*SPANS[kind]), r) for r in roots)


# turns and cameras


def euler_matrix(order: str, angles: Vector) -> list[list[Column]]:
    """The 3 x 3 rotation of three turns. Lower-case orders ('xyz') turn about the moving axes, left to right; 'sxyz' about fixed ones."""
    fixed, axes = (True, order[1:]) if order.startswith("s") else (False, order)
    if len(axes) != 3 or set(axes) - set("xyz") or axes[0] == axes[1] or axes[1] == axes[2]:
        raise ValueError(f"no order of turns: {order}")
    out = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    for axis, angle in zip(axes, _v(angles), strict=True):
        c, s = F.cos(angle), F.sin(angle)
        i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
        turn = [[F.lit(float(a == b)) for b in range(3)] for a in range(3)]
        turn[i][i], turn[i][j], turn[j][i], turn[j][j] = c, -s, s, c
        a, b = (turn, out) if fixed else (out, turn)
        out = [[dot(a[r], [b[k][q] for k in range(3)]) for q in range(3)] for r in range(3)]
    return out


#: All 24 orders: 12 about moving and 12 about fixed axes.
EULER_ORDERS = tuple(p + a + b + c for p in ("", "s") for a in "xyz" for b in "xyz" if b != a for c in "xyz" if c != b)


def quaternion_matrix(q: Vector) -> list[list[Column]]:
    """Rotation of a unit quaternion (x, y, z, w)."""
    x, y, z, w = _v(q)
    one = F.lit(1.0)
    return [
        [one - (y * y + z * z) * 2, (x * y - z * w) * 2, (x * z + y * w) * 2],
        [(x * y + z * w) * 2, one - (x * x + z * z) * 2, (y * z - x * w) * 2],
        [(x * z - y * w) * 2, (y * z + x * w) * 2, one - (x * x + y * y) * 2],
    ]


def rotate3(m: list[list[Column]], p: Vector) -> list[Column]:
    return [dot(row, p) for row in m]


def unrotate3(m: list[list[Column]], p: Vector) -> list[Column]:
    return [dot([m[r][c] for r in range(3)], p) for c in range(3)]


def path_pose(x: Column | str, y: Column | str, heading: Column | str, z: float) -> Column:
    """The 4 x 4 pose, row by row, of a plane pose lifted to height z."""
    c, s = F.cos(_c(heading)), F.sin(_c(heading))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, _c(x), s, c, zero, _c(y), zero, zero, one, F.lit(float(z)), zero, zero, zero, one)


def optical_to_body(p: Vector) -> list[Column]:
    """Camera axes (right, down, ahead) to body axes (ahead, left, up)."""
    x, y, z = _v(p)
    return [z, -x, -y]


def body_to_optical(p: Vector) -> list[Column]:
    x, y, z = _v(p)
    return [-y, -z, x]


def pixel_direction(u: Column | str, v: Column | str, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """The point at depth 1 that a pixel sees, in camera axes."""
    return [(_c(u) - cx) / fx, (_c(v) - cy) / fy, F.lit(1.0)]


def depth_to_distance(depth: Column | str, u: Column | str, v: Column | str, fx: float, fy: float, cx: float, cy: float) -> Column:
    return _c(depth) * norm(pixel_direction(u, v, fx, fy, cx, cy))


def distance_to_depth(distance: Column | str, u: Column | str, v: Column | str, fx: float, fy: float, cx: float, cy: float) -> Column:
    return _c(distance) / norm(pixel_direction(u, v, fx, fy, cx, cy))


def resize_intrinsics(fx: float, fy: float, cx: float, cy: float, factor: float) -> tuple[float, float, float, float]:
    return fx * factor, fy * factor, cx * factor, cy * factor


def azimuth_elevation(p: Vector) -> tuple[Column, Column]:
    x, y, z = _v(p)
    return F.atan2(y, x), F.asin(F.coalesce(div(z, norm(p)), F.lit(0.0)))


# triangles


def triangle_normal(a: Vector, b: Vector, c: Vector) -> list[Column]:
    n = cross3(sub(b, a), sub(c, a))
    size = norm(n)
    return [F.coalesce(div(x, size), F.lit(0.0)) for x in n]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross3(sub(b, a), sub(c, a))) / 2


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> list[Column]:
    """Weights of the corners of a point in the triangle's plane."""
    d, e, w = sub(b, a), sub(c, a), sub(p, a)
    dd, de, ee, wd, we = dot(d, d), dot(d, e), dot(e, e), dot(w, d), dot(w, e)
    n = dd * ee - de * de
    v, u = div(ee * wd - de * we, n), div(dd * we - de * wd, n)
    return [F.lit(1.0) - v - u, v, u]


def point_triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance to the plane where the foot is in the triangle, else to the nearest edge."""
    weights = barycentric(p, a, b, c)
    inside = F.coalesce((weights[0] >= 0) & (weights[1] >= 0) & (weights[2] >= 0), F.lit(False))
    plane = F.abs(dot(sub(p, a), triangle_normal(a, b, c)))
    edges = F.least(point_segment_distance(p, a, b), point_segment_distance(p, b, c), point_segment_distance(p, c, a))
    return F.when(inside, plane).otherwise(edges)
