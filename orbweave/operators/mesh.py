"""Contours and meshes: marching squares and cubes, mesh distances, hulls, hidden points, triangulation.

Cells of a grid are told their corners by one grouping; case tables are derived from a rule and broadcast. Algorithms
that walk (chains of contours, hulls, ears) are Arrow kernels on one map, view or polygon each.
"""

from __future__ import annotations

import functools
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import cross3, dot, point_triangle_distance, sub, triangle_area, triangle_normal

# marching squares


def square_corners(grid: DataFrame, map_id: str | None = None) -> DataFrame:
    """row, col, v00, v01, v10, v11 of each square whose four corners are there."""
    by = [map_id] if map_id else []
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in product((0, 1), repeat=2)])
    told = grid.select(*by, "row", "col", "value", F.explode(corner).alias("_c"))
    told = told.select(*by, (F.col("row") - F.col("_c.i")).alias("row"), (F.col("col") - F.col("_c.j")).alias("col"), (F.col("_c.i") * 2 + F.col("_c.j")).alias("_k"), "value")
    pick = [F.max(F.when(F.col("_k") == k, F.col("value"))).alias(n) for k, n in enumerate(("v00", "v01", "v10", "v11"))]
    return told.groupBy(*by, "row", "col").agg(*pick, F.count(F.lit(1)).alias("_n")).filter("_n = 4").drop("_n")


def marching_squares(grid: DataFrame, iso: float, map_id: str | None = None) -> DataFrame:
    """row, col, segment, x1, y1, x2, y2: the contour's segments. Inside is value <= iso; x runs with col, y with row."""
    by = [map_id] if map_id else []
    c = square_corners(grid, map_id)
    inside = [F.when(F.col(v) <= iso, 1).otherwise(0) for v in ("v00", "v01", "v11", "v10")]
    case = inside[0] + inside[1] * 2 + inside[2] * 4 + inside[3] * 8
    # edges: 0 between corners 0 and 1, and so on around
    at = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    names = ["v00", "v01", "v11", "v10"]

    def edge_point(e: int) -> tuple[Column, Column]:
        a, b = F.col(names[e]), F.col(names[(e + 1) % 4])
        wa, wb = F.abs(b - iso), F.abs(a - iso)
        t = F.when(wa + wb > 0, wb / F.when(wa + wb > 0, wa + wb)).otherwise(0.5)
        (r0, c0), (r1, c1) = at[e], at[(e + 1) % 4]
        return F.col("col") + c0 + t * (c1 - c0), F.col("row") + r0 + t * (r1 - r0)

    lists = []
    for k in range(16):
        bits = [(k >> i) & 1 for i in range(4)]
        crossed = [e for e in range(4) if bits[e] != bits[(e + 1) % 4]]
        pairs = []
        if len(crossed) == 2:
            pairs = [(crossed[0], crossed[1])]
        elif len(crossed) == 4:  # inside corners stay apart
            pairs = [(0, 3), (1, 2)] if bits[0] else [(0, 1), (2, 3)]
        segments = [F.struct(*[p.alias(n) for p, n in zip((*edge_point(a), *edge_point(b)), ("x1", "y1", "x2", "y2"), strict=True)]) for a, b in pairs]
        lists.append(F.array(*segments) if segments else F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    found = F.lit(None)
    for k, segments in enumerate(lists):
        found = F.when(F.col("_case") == k, segments) if k == 0 else found.when(F.col("_case") == k, segments)
    cut = c.withColumn("_case", case).filter("_case > 0 and _case < 15").select(*by, "row", "col", F.posexplode(found).alias("segment", "_s"))
    return cut.select(*by, "row", "col", "segment", "_s.x1", "_s.y1", "_s.x2", "_s.y2")


def chain_segments(segments: DataFrame, map_id: str, digits: int = 9) -> DataFrame:
    """map_id, obj_id, vid, x, y: segments chained into lines, one kernel a map."""

    def run(table: pa.Table) -> pa.Table:
        s = np.round(np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1), digits)
        ends: dict[tuple, list[int]] = {}
        for i, (a, b, c, d) in enumerate(s.tolist()):
            ends.setdefault((a, b), []).append(i)
            ends.setdefault((c, d), []).append(i)
        used, rows = set(), []
        starts = sorted(ends, key=lambda p: (len(ends[p]) != 1, p))
        obj = 0
        for p in starts:
            for first in ends[p]:
                if first in used:
                    continue
                line, now, i = [p], p, first
                while i is not None:
                    used.add(i)
                    a, b, c, d = s[i].tolist()
                    now = (c, d) if (a, b) == now else (a, b)
                    line.append(now)
                    i = next((j for j in ends[now] if j not in used), None)
                rows += [(obj, k, x, y) for k, (x, y) in enumerate(line)]
                obj += 1
        m = table.column(map_id)[0].as_py() if table.num_rows else None
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({"map_id": pa.array([m] * len(rows), pa.int64()), "obj_id": pa.array(cols[0], pa.int32()), "vid": pa.array(cols[1], pa.int32()), "x": pa.array(cols[2], pa.float64()), "y": pa.array(cols[3], pa.float64())})

    return segments.groupBy(map_id).applyInArrow(run, "map_id long, obj_id int, vid int, x double, y double")


# marching cubes

#: Corners of a cube in binary order, and its edges as pairs of them.
CUBE = list(product((0, 1), repeat=3))
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if sum(x != y for x, y in zip(CUBE[a], CUBE[b], strict=True)) == 1]
#: Faces as rings of corners.
FACES = [[(0, 2, 3, 1), (4, 5, 7, 6)], [(0, 1, 5, 4), (2, 6, 7, 3)], [(0, 4, 6, 2), (1, 3, 7, 5)]]


@functools.lru_cache(maxsize=1)
def cube_cases() -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each set of inside corners, triangles of crossed edges.

    On each face, walked around, the contour enters where inside turns to outside and leaves at the next turn back: inside
    corners of a face that touch at a diagonal stay apart, on both cubes that share it. The pieces form rings over the
    cube, which are cut into fans.
    """
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    cases = []
    for case in range(256):
        inside = [(case >> c) & 1 for c in range(8)]
        nxt = {}
        for ring in (r for pair in FACES for r in pair):
            crossed = [(number[frozenset((ring[i], ring[(i + 1) % 4]))], inside[ring[i]]) for i in range(4) if inside[ring[i]] != inside[ring[(i + 1) % 4]]]
            for i, (edge, leaving) in enumerate(crossed):
                if leaving:  # from inside to outside; the piece goes back around the inside corners to where they began
                    nxt[crossed[i - 1][0]] = edge
        triangles, seen = [], set()
        for start in sorted(nxt):
            if start in seen:
                continue
            loop, at = [], start
            while at not in seen:
                seen.add(at)
                loop.append(at)
                at = nxt[at]
            triangles += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
        cases.append(tuple(triangles))
    return tuple(cases)


def cube_corners(grid: DataFrame) -> DataFrame:
    """i, j, k, v0 to v7 of each cube whose eight corners are there; grid: i, j, k, value."""
    told = grid.select("i", "j", "k", "value", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(c[x]).alias("abc"[x]) for x in range(3)]) for n, c in enumerate(CUBE)])).alias("_c"))
    told = told.select(*[(F.col(x) - F.col(f"_c.{y}")).alias(x) for x, y in zip("ijk", "abc", strict=True)], "_c.n", "value")
    pick = [F.max(F.when(F.col("n") == n, F.col("value"))).alias(f"v{n}") for n in range(8)]
    return told.groupBy("i", "j", "k").agg(*pick, F.count(F.lit(1)).alias("_n")).filter("_n = 8").drop("_n")


def marching_cubes(grid: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), step: float = 1.0) -> DataFrame:
    """i, j, k, triangle, corner, edge (its cube and axis, shared by neighbours), x, y, z. Inside is value < 0; iso is 0."""
    cubes = cube_corners(grid)
    case = sum((F.when(F.col(f"v{n}") < 0, 1 << n).otherwise(0) for n in range(1, 8)), F.when(F.col("v0") < 0, 1).otherwise(0))
    table = F.array(*[F.array(*[F.struct(*[F.lit(e).alias("xyz"[n]) for n, e in enumerate(t)]) for t in c]) if c else F.array().cast("array<struct<x:int,y:int,z:int>>") for c in cube_cases()])
    spark = grid.sparkSession
    rows = spark.range(1).select(F.posexplode(table).alias("_case", "_t")).select("_case", F.posexplode("_t").alias("triangle", "_e"))
    cut = cubes.withColumn("_case", case).filter("_case > 0 and _case < 255").join(F.broadcast(rows), "_case")
    cut = cut.select("*", F.posexplode(F.array("_e.x", "_e.y", "_e.z")).alias("corner", "_n"))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES])
    cut = cut.withColumn("_ab", F.element_at(ends, F.col("_n") + 1))
    v = F.array(*[F.col(f"v{n}") for n in range(8)])
    va, vb = F.element_at(v, F.col("_ab.a") + 1), F.element_at(v, F.col("_ab.b") + 1)
    t = F.when(F.abs(va - vb) < 1e-6, 0.5).otherwise(va / F.when(F.abs(va - vb) >= 1e-6, va - vb))
    at = []
    for n, axis in enumerate("ijk"):
        offsets = F.array(*[F.lit(float(c[n])) for c in CUBE])
        oa, ob = F.element_at(offsets, F.col("_ab.a") + 1), F.element_at(offsets, F.col("_ab.b") + 1)
        at.append((F.lit(float(origin[n])) + (F.col(axis) + oa + t * (ob - oa)) * float(step)).alias("xyz"[n]))
    low = [F.col(axis) + F.element_at(F.array(*[F.lit(c[n]) for c in CUBE]), F.col("_ab.a") + 1) for n, axis in enumerate("ijk")]
    axis_of = F.element_at(F.array(*[F.lit(next(n for n in range(3) if CUBE[a][n] != CUBE[b][n])) for a, b in EDGES]), F.col("_n") + 1)
    return cut.select("i", "j", "k", "triangle", "corner", F.struct(*[x.cast("int").alias("ijk"[n]) for n, x in enumerate(low)], axis_of.alias("axis")).alias("edge"), *at)


def numbered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df with a gapless number from 0 in the order given: ranges are sorted and counted apart, and only their counts are summed in one task."""
    from orbweave.sources.shared import settle

    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each task
    return joined.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias(name))


def mesh_of(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of marching_cubes(): a vertex for each crossed edge, numbered in order; faces of vertex numbers."""
    unique = corners.groupBy("edge").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    vertices = numbered(unique, "vid", ["edge"])
    named = corners.join(vertices.select("edge", "vid"), "edge")
    pick = [F.max(F.when(F.col("corner") == n, F.col("vid"))).alias(c) for n, c in enumerate("abc")]
    faces = numbered(named.groupBy("i", "j", "k", "triangle").agg(*pick), "fid", ["i", "j", "k", "triangle"])
    return vertices.select("vid", "x", "y", "z"), faces.select("fid", "a", "b", "c")


# meshes


def face_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, ax to cz: faces with their corners' coordinates."""
    out = faces
    for c in "abc":
        out = out.join(vertices.select(F.col("vid").alias(c), *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), c)
    return out.select("fid", *[f"{c}{x}" for c in "abc" for x in "xyz"])


def _abc() -> tuple[list[str], list[str], list[str]]:
    return tuple([f"{c}{x}" for x in "xyz"] for c in "abc")


def face_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, area, nx, ny, nz."""
    a, b, c = _abc()
    n = triangle_normal(a, b, c)
    return face_corners(vertices, faces).select("fid", triangle_area(a, b, c).alias("area"), *[x.alias(f"n{k}") for x, k in zip(n, "xyz", strict=True)])


def cumulative_areas(vertices: DataFrame, faces: DataFrame, block: int = 4096) -> DataFrame:
    """fid, area, total: face areas and their sum up to each face, by blocks of face numbers whose sums alone are added up in one task."""
    sized = face_measures(vertices, faces).select("fid", "area", F.floor(F.col("fid") / block).alias("_b"))
    sums = sized.groupBy("_b").agg(F.sum("area").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    own = F.sum("area").over(Window.partitionBy("_b").orderBy("fid"))
    return sized.withColumn("_own", own).join(before, "_b").select("fid", "area", (F.col("_before") + F.col("_own")).alias("total"))


def mesh_distance(points: DataFrame, point_id: str, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """point_id, sdf: distance to the nearest face, positive outside; exact, with the mesh broadcast after a check of its size.

    The sign is the solid angle's: the mesh must be closed and its faces turned outward.
    """
    from orbweave.operators.surface import BROADCAST

    corners = face_corners(vertices, faces)
    if corners.limit(BROADCAST + 1).count() > BROADCAST:
        raise ValueError(f"more than {BROADCAST} faces: cut the mesh into tiles")
    met = points.withColumn("_all", F.lit(1)).join(F.broadcast(corners.withColumn("_all", F.lit(1))), "_all")
    a, b, c = _abc()
    p = ["x", "y", "z"]
    u, v, w = sub(a, p), sub(b, p), sub(c, p)
    lu, lv, lw = (F.sqrt(dot(q, q)) for q in (u, v, w))
    angle = F.atan2(dot(u, cross3(v, w)), lu * lv * lw + dot(u, v) * lw + dot(v, w) * lu + dot(w, u) * lv) * 2
    both = met.groupBy(point_id).agg(F.min(point_triangle_distance(p, a, b, c)).alias("d"), F.sum(angle).alias("o"))
    return both.select(point_id, F.when(F.abs("o") > 6.283185307179586, -F.col("d")).otherwise(F.col("d")).alias("sdf"))


def mesh_volume(vertices: DataFrame, faces: DataFrame) -> float:
    """The signed volume of a closed mesh: negative if its faces are turned inward."""
    a, b, c = _abc()
    return face_corners(vertices, faces).agg(F.sum(dot(a, cross3(b, c)) / 6)).first()[0] or 0.0


def outward(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The faces of a closed mesh, all turned over if they are turned inward."""
    return faces if mesh_volume(vertices, faces) >= 0 else faces.select("fid", "a", F.col("c").alias("b"), F.col("b").alias("c"))


def mesh_contains(points: DataFrame, point_id: str, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return mesh_distance(points, point_id, vertices, faces).filter("sdf <= 0").select(point_id)


def mesh_summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """area and the box of a mesh, a row."""
    box = vertices.agg(*[f(x).alias(f"{n}_{x}") for x in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]).withColumn("_one", F.lit(1))
    return face_measures(vertices, faces).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("faces")).withColumn("_one", F.lit(1)).join(box, "_one").drop("_one")


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n points (fid, x, y, z) spread evenly over the area, reflected into their triangle."""
    corners = face_corners(vertices, faces)
    a, b, c = _abc()
    sized = corners.withColumn("_area", triangle_area(a, b, c))
    total = sized.agg(F.sum("_area")).first()[0] or 0.0
    want = F.col("_area") / F.lit(float(total) or 1.0) * n
    drawn = sized.withColumn("_w", want).withColumn("_n", (F.floor("_w") + (F.rand(seed) < F.col("_w") - F.floor("_w")).cast("int")).cast("int")).filter("_n > 0")
    drawn = drawn.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_u", F.rand(seed + 1)).withColumn("_v", F.rand(seed + 2))
    over = F.col("_u") + F.col("_v") > 1
    u, v = F.when(over, 1 - F.col("_u")).otherwise(F.col("_u")), F.when(over, 1 - F.col("_v")).otherwise(F.col("_v"))
    return drawn.select("fid", *[(F.col(f"a{x}") + u * (F.col(f"b{x}") - F.col(f"a{x}")) + v * (F.col(f"c{x}") - F.col(f"a{x}"))).alias(x) for x in "xyz"])


# kernels


def hull_faces(points: np.ndarray) -> np.ndarray:
    """Faces (indices, turned outward) of the convex hull of points in space, by quickhull with sets of outside points."""
    p = np.asarray(points, float)
    if len(p) < 4:
        return np.zeros((0, 3), int)
    i0 = int(p[:, 0].argmin())
    i1 = int(((p - p[i0]) ** 2).sum(1).argmax())
    d = p[i1] - p[i0]
    i2 = int((np.cross(p - p[i0], d) ** 2).sum(1).argmax())
    n = np.cross(d, p[i2] - p[i0])
    i3 = int(np.abs((p - p[i0]) @ n).argmax())
    eps = 1e-10 * max(1.0, float(np.abs(p).max()))
    if abs((p[i3] - p[i0]) @ n) <= eps * max(1.0, float(np.linalg.norm(n))):
        return np.zeros((0, 3), int)
    middle = p[[i0, i1, i2, i3]].mean(0)
    faces: dict[int, tuple[int, int, int]] = {}
    plane: dict[int, tuple[np.ndarray, float]] = {}
    outside: dict[int, np.ndarray] = {}
    edges: dict[tuple[int, int], int] = {}
    made = 0

    def add(a: int, b: int, c: int, candidates: np.ndarray) -> int:
        nonlocal made
        m = np.cross(p[b] - p[a], p[c] - p[a])
        size = np.linalg.norm(m)
        m = m / size if size else m
        if m @ (middle - p[a]) > 0:
            b, c, m = c, b, -m
        f, made = made, made + 1
        faces[f], plane[f] = (a, b, c), (m, float(m @ p[a]))
        outside[f] = candidates[(p[candidates] @ m - plane[f][1]) > eps] if len(candidates) else candidates
        for x, y in ((a, b), (b, c), (c, a)):
            edges[x, y] = f
        return f

    rest = np.setdiff1d(np.arange(len(p)), [i0, i1, i2, i3])
    for t in ((i0, i1, i2), (i0, i1, i3), (i0, i2, i3), (i1, i2, i3)):
        f = add(*t, rest)
        rest = np.setdiff1d(rest, outside[f])
    stack = [f for f in faces if len(outside[f])]
    while stack:
        f = stack.pop()
        if f not in faces or not len(outside[f]):
            continue
        far = int(outside[f][(p[outside[f]] @ plane[f][0]).argmax()])
        seen, todo, horizon = {f}, [f], []
        while todo:
            g = todo.pop()
            a, b, c = faces[g]
            for x, y in ((a, b), (b, c), (c, a)):
                h = edges[y, x]
                if h in seen:
                    continue
                if plane[h][0] @ p[far] - plane[h][1] > eps:
                    seen.add(h)
                    todo.append(h)
                else:
                    horizon.append((x, y))
        horizon = [(x, y) for x, y in horizon if edges[y, x] not in seen]
        candidates = np.unique(np.concatenate([outside[g] for g in seen]))
        candidates = candidates[candidates != far]
        for g in seen:
            del faces[g], plane[g], outside[g]
        for x, y in horizon:
            g = add(x, y, far, candidates)
            candidates = np.setdiff1d(candidates, outside[g], assume_unique=True)
            if len(outside[g]):
                stack.append(g)
    return np.array(list(faces.values()), int)


def convex_hull(points: DataFrame, group: str, index: str = "pt_idx") -> DataFrame:
    """group, fid, a, b, c: the hull's faces of each group's points by index, turned outward."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        ids = table.column(index).to_numpy()
        f = hull_faces(np.stack([table.column(c).to_numpy() for c in "xyz"], 1))
        g = table.column(group)[0].as_py()
        return pa.table({group: pa.array([g] * len(f), pa.int64()), "fid": pa.array(range(len(f)), pa.int32()), **{c: pa.array(ids[f[:, n]] if len(f) else [], pa.int64()) for n, c in enumerate("abc")}})

    rows = points.select(F.col(group).cast("long").alias(group), F.col(index).cast("long").alias(index), "x", "y", "z")
    return rows.groupBy(group).applyInArrow(run, f"{group} long, fid int, a long, b long, c long")


def visible_points(points: DataFrame, view: str, index: str = "pt_idx", factor: float = 100.0) -> DataFrame:
    """view, index of the points seen from each view's origin: hull vertices of the cloud flipped over a sphere (x, y, z are relative to the view)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column(index).to_numpy()
        p = np.stack([table.column(c).to_numpy() for c in "xyz"], 1)
        size = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        flipped = p + 2 * (size.max() * factor - size) * p / size
        f = hull_faces(np.concatenate([flipped, np.zeros((1, 3))]))
        seen = np.unique(f)
        seen = seen[seen < len(p)] if len(f) else np.arange(len(p))
        return pa.table({view: pa.array([table.column(view)[0].as_py()] * len(seen), pa.int64()), index: pa.array(np.sort(ids[seen]), pa.int64())})

    rows = points.select(F.col(view).cast("long").alias(view), F.col(index).cast("long").alias(index), "x", "y", "z")
    return rows.groupBy(view).applyInArrow(run, f"{view} long, {index} long")


def ear_clip(outer: np.ndarray, holes: list[np.ndarray] = ()) -> list[tuple[int, int, int]]:
    """Triangles (indices into outer, then the holes in order) of a polygon with holes."""
    p = np.concatenate([outer, *holes]) if len(holes) else np.asarray(outer, float)
    area = lambda ring: sum(p[a][0] * p[b][1] - p[b][0] * p[a][1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
    side = lambda a, b, c: (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])
    ring = list(range(len(outer)))
    ring = ring if area(ring) > 0 else ring[::-1]
    at, rings = len(outer), []
    for h in holes:
        own = list(range(at, at + len(h)))
        rings.append(own if area(own) < 0 else own[::-1])
        at += len(h)

    def crosses(a: int, b: int, c: int, d: int) -> bool:
        if {a, b} & {c, d}:
            return False
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    for k, hole in sorted(enumerate(rings), key=lambda h: -max(p[i][0] for i in h[1])):
        start = max(range(len(hole)), key=lambda i: p[hole[i]][0])
        hole = hole[start:] + hole[:start]
        walls = [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))] + [(r[i], r[(i + 1) % len(r)]) for r in rings[k:] for i in range(len(r))]
        order = sorted(range(len(ring)), key=lambda i: ((p[ring[i]] - p[hole[0]]) ** 2).sum())
        j = next(i for i in order if not any(crosses(hole[0], ring[i], c, d) for c, d in walls))
        ring = [*ring[: j + 1], *hole, hole[0], *ring[j:]]
    out = []
    while len(ring) > 3:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            if side(a, b, c) <= 0:
                continue
            corners = {tuple(p[q]) for q in (a, b, c)}
            if any(side(a, b, q) >= 0 and side(b, c, q) >= 0 and side(c, a, q) >= 0 for q in ring if tuple(p[q]) not in corners):
                continue
            out.append((a, b, c))
            del ring[i]
            break
        else:  # what is left has no area
            flat = next((i for i in range(len(ring)) if abs(side(ring[i - 1], ring[i], ring[(i + 1) % len(ring)])) < 1e-12), 0)
            del ring[flat]
    if len(ring) == 3 and abs(side(*ring)) > 0:
        out.append(tuple(ring))
    return out


def triangulate(vertices: DataFrame, polygon: str = "poly_id") -> DataFrame:
    """polygon, fid, a, b, c: triangles of vertex numbers. vertices: polygon, ring (0 is the outer one), vid, x, y."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ring", "ascending"), ("vid", "ascending")])
        rings, ids = table.column("ring").to_numpy(), table.column("vid").to_numpy()
        p = np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], 1)
        f = ear_clip(p[rings == 0], [p[rings == r] for r in np.unique(rings) if r])
        g = table.column(polygon)[0].as_py()
        cols = list(zip(*f, strict=True)) if f else ([], [], [])
        return pa.table({polygon: pa.array([g] * len(f), pa.int64()), "fid": pa.array(range(len(f)), pa.int32()), **{c: pa.array(ids[list(x)] if f else [], pa.int64()) for c, x in zip("abc", cols, strict=True)}})

    rows = vertices.select(F.col(polygon).cast("long").alias(polygon), F.col("ring").cast("int").alias("ring"), F.col("vid").cast("long").alias("vid"), "x", "y")
    return rows.groupBy(polygon).applyInArrow(run, f"{polygon} long, fid int, a long, b long, c long")


def extrude(vertices: DataFrame, height: float, obj: str = "obj_id", order: str = "vid") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the walls of polygons, two triangles a wall; tops are numbered after all bottoms of the polygon."""
    n = F.count(F.lit(1)).over(Window.partitionBy(obj)).cast("int")
    i = F.row_number().over(Window.partitionBy(obj).orderBy(order)) - 1
    marked = vertices.select(obj, "x", "y", i.alias("_i"), n.alias("_n"))
    bottom = marked.select(obj, F.col("_i").alias("vid"), "x", "y", F.lit(0.0).alias("z"))
    top = marked.select(obj, (F.col("_i") + F.col("_n")).alias("vid"), "x", "y", F.lit(float(height)).alias("z"))
    j = (F.col("_i") + 1) % F.col("_n")
    two = F.array(F.struct(F.col("_i").alias("a"), j.alias("b"), (j + F.col("_n")).alias("c")), F.struct(F.col("_i").alias("a"), (j + F.col("_n")).alias("b"), (F.col("_i") + F.col("_n")).alias("c")))
    faces = marked.select(obj, (F.col("_i") * 2).alias("_f"), F.posexplode(two).alias("_k", "_t")).select(obj, (F.col("_f") + F.col("_k")).alias("fid"), "_t.a", "_t.b", "_t.c")
    return bottom.unionByName(top), faces


def ellipsoid_points(df: DataFrame, radii: tuple[float, float, float], rows: int, cols: int) -> DataFrame:
    """A grid of points on an ellipsoid; df gives the session."""
    import math

    g = df.sparkSession.range(rows * cols)
    u, v = F.floor(F.col("id") / cols) / (rows - 1) * math.pi, (F.col("id") % cols) / cols * 2 * math.pi
    return g.select(F.col("id").alias("vid"), (F.sin(u) * F.cos(v) * radii[0]).alias("x"), (F.sin(u) * F.sin(v) * radii[1]).alias("y"), (F.cos(u) * radii[2]).alias("z"))


