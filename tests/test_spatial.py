"""Golden values, properties and oracles of the spatial engine."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.functions import keys as K
from orbweave.operators import gridmap, hilbert, mesh, neighbors, rays, sensors, surface, tree
from orbweave.plans import queries as Q
from orbweave.sources import maps
from orbweave.streaming.ingest import Snapshots

S2 = K.TreeSetting(resolution=0.01)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_keys(spark):
    s = K.TreeSetting(resolution=0.05)
    assert one(spark, c=K.centre(K.key(F.lit(0.0), s), s)).c == pytest.approx(0.025)
    s = K.TreeSetting(resolution=0.1)
    r = one(spark, x=K.centre(F.lit(32888), s, 14), y=K.centre(F.lit(32760), s, 14), kx=K.at_depth(K.key(F.lit(12.2), s), 14, s), ky=K.at_depth(K.key(F.lit(-0.6), s), 14, s))
    assert (r.x, r.y) == (pytest.approx(12.2), pytest.approx(-0.6)) and (r.kx, r.ky) == (32890, 32762)


def cells(spark, keys, value=0.85):
    names = ["kx", "ky", "kz"][: len(keys[0])]
    return spark.createDataFrame(keys, ", ".join(f"{n} int" for n in names)).select(F.lit(16).alias("d"), *names, F.lit(value).alias("log_odds"))


def size(leaves, s=S2):
    return tree.tree_size(leaves, s).first().nodes


@pytest.mark.parametrize(("n", "want"), [(1, 17), (4, 16)])
def test_quadtree_sizes(spark, n, want):
    k = 32764
    block = [(k, k), (k + 1, k + 1), (k + 1, k), (k, k + 1)][:n]
    assert size(tree.prune(cells(spark, block), S2)) == want


def test_prune_expand_are_inverse(spark):
    block = [(32768 + i, 32768 + j) for i in range(8) for j in range(8)] + [(30000, 40000)]
    leaves = cells(spark, block)
    pruned = tree.prune(leaves, S2)
    assert sorted(r.d for r in pruned.collect()) == [13, 16]
    assert tree.same_tree(tree.expand(pruned, S2), leaves)
    assert tree.prune(leaves.limit(0), S2).count() == 0


def test_octree_block(spark):
    block = [(32768 + i, 32768 + j, 32768 + k) for i in range(4) for j in range(4) for k in range(4)]
    pruned = tree.prune(cells(spark, block), S2)
    assert [r.d for r in pruned.collect()] == [14]


def test_update_splits_pruned_leaf(spark):
    block = [(32768 + i, 32768 + j) for i in range(4) for j in range(4)]
    pruned = tree.prune(cells(spark, block), S2)
    new = spark.createDataFrame([(1, 32769, 32769, -0.4)], "frame long, kx int, ky int, delta double")
    out = tree.update_cells(new, S2, ["frame"], pruned)
    assert sorted(r.d for r in out.collect()) == [15, 15, 15, 16, 16, 16, 16]


def test_fold_orders_and_clamps(spark):
    s = K.TreeSetting()
    u = spark.createDataFrame([(i, 1, 1, d) for i, d in enumerate([0.85] * 6 + [-0.4])], "frame long, kx int, ky int, delta double")
    assert tree.update_cells(u, s, ["frame"]).first().log_odds == pytest.approx(3.1)


def literal_walk(sx, sy, ex, ey, res, off):
    """Cells between two points by steps of the nearest border."""
    k = [math.floor(sx / res) + off, math.floor(sy / res) + off]
    end = [math.floor(ex / res) + off, math.floor(ey / res) + off]
    out = []
    d = (ex - sx, ey - sy)
    while k != end and len(out) < 10_000:
        out.append(tuple(k))
        t = [((k[i] - off + (d[i] > 0)) * res - (sx, sy)[i]) / d[i] if k[i] != end[i] else math.inf for i in (0, 1)]
        i = 0 if t[0] < t[1] else 1
        k[i] += 1 if d[i] > 0 else -1
    return out


def test_ray_traversal(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.uniform(-5, 5, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "ray int, sx double, sy double, ex double, ey double")
    s = K.TreeSetting(resolution=0.25)
    got = {}
    for c in rays.ray_cells(df, ["sx", "sy"], ["ex", "ey"], s).orderBy("ray", "step").collect():
        got.setdefault(c.ray, []).append((c.kx, c.ky))
    for i, *xs in rows:
        assert got.get(i, []) == literal_walk(*xs, 0.25, s.offset)


def test_ray_traversal_in_space_moves_one_face_at_a_time(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, r.uniform(-3, 3, 6))) for i in range(30)], "ray int, sx double, sy double, sz double, ex double, ey double, ez double")
    s = K.TreeSetting(resolution=0.25)
    got = {}
    for c in rays.ray_cells(df, ["sx", "sy", "sz"], ["ex", "ey", "ez"], s, include_end=True).orderBy("ray", "step").collect():
        got.setdefault(c.ray, []).append((c.kx, c.ky, c.kz))
    for row in df.collect():
        path = got[row.ray]
        assert path[-1] == tuple(math.floor(row[4 + i] / 0.25) + s.offset for i in range(3))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize(("axes", "both_ways", "padding", "min_depth"), [(2, False, 0.0, 0), (2, True, 0.3, 2), (3, False, 0.0, 0)])
def test_nodes_on_rays_of_a_pruned_tree(spark, axes, both_ways, padding, min_depth):
    s = K.TreeSetting(resolution=0.25, depth=6)
    r = np.random.default_rng(5)
    names = ["kx", "ky", "kz"][:axes]
    leaves, stack = [], [(0, (0,) * axes)]
    while stack:  # leaves of all depths from 1
        d, k = stack.pop()
        if d == s.depth or (d > 0 and r.random() < (0.4 if axes == 2 else 0.6)):
            leaves.append((d, *k, 0.85))
        else:
            half = 2 ** (s.depth - d - 1)
            stack += [(d + 1, tuple(x + half * (j >> i & 1) for i, x in enumerate(k))) for j in range(2**axes)]
    assert {1, 2, 3} <= {x[0] for x in leaves}
    shot = []
    for i in range(25):
        v = r.normal(size=axes)
        shot.append((i, *map(float, r.uniform(-3, 3, axes)), *map(float, v / np.linalg.norm(v))))
    a, v = [f"a{i}" for i in range(axes)], [f"v{i}" for i in range(axes)]
    df = spark.createDataFrame(shot, "ray int, " + ", ".join(f"{c} double" for c in [*a, *v]))
    table = spark.createDataFrame(leaves, "d int, " + ", ".join(f"{k} int" for k in names) + ", log_odds double")
    got = {(x.ray, x.d, *[x[k] for k in names]) for x in rays.nodes_on_rays(df, "ray", table, s, a, v, 4.5, padding, both_ways, min_depth, coarse=4).collect()}
    want = set()
    for i, *x in shot:
        p, q = np.array(x[:axes]), np.array(x[axes:])
        for d, *k, _ in leaves:
            size = 2 ** (s.depth - d)
            low = (np.array(k) // size * size - 32) * 0.25 - padding
            t = np.stack([(low - p) / q, (low + size * 0.25 + 2 * padding - p) / q])
            near, far = t.min(0).max(), t.max(0).min()
            if d >= min_depth and near <= far and abs(near) <= 4.5 and (both_ways or far >= 0):
                want.add((i, d, *k))
    assert got == want and any(x[1] < 4 for x in want)


def test_sphere_tracing_of_hits_misses_grazes_and_inside_starts(spark):
    r = np.random.default_rng(6)
    y = [0.0, 0.5, 0.9, 0.95, 0.99, 0.999, 0.9999, 1.0, 1.0001, 1.01, 1.5, -0.97, -1.0, -3.0, *r.uniform(-2, 2, 150)]
    starts = [(float(x), float(b)) for x in (-20.0, -3.0, -0.4, 0.0, 0.3, 5.0) for b in y] + [(-40.0, 0.2), (-40.0, 2.0)]
    df = spark.createDataFrame([(i, *p, 1.0, 0.0) for i, p in enumerate(starts)], "id int, x double, y double, vx double, vy double")
    got = {g.id: g for g in rays.sphere_trace(df, ["x", "y"], ["vx", "vy"], lambda q: F.sqrt(q[0] * q[0] + q[1] * q[1]) - 1.0, 30.0).collect()}
    for i, (x, b) in enumerate(starts):
        t, side = 0.0, -1 if math.hypot(x, b) < 1 else 1
        for _ in range(64):
            t = t if t > 30 else t + side * (math.hypot(x + t, b) - 1)
        assert got[i].t == pytest.approx(t, abs=1e-6) and got[i].hit == (t <= 30 and abs(math.hypot(x + t, b) - 1) <= 1e-5), (x, b)
        root = math.sqrt(max(0.0, 1 - b * b))
        ahead = [t for t in (-root - x, root - x) if abs(b) <= 1 and 0 <= t <= 30]
        if got[i].hit:  # never a hit where there is none, nor behind the start
            assert ahead and got[i].t == pytest.approx(ahead[0], abs=1e-3 if abs(b) <= 0.9 else 0.02), (x, b)
        elif ahead:
            assert abs(b) > 0.9, (x, b)


def test_circle_rays_all_hit(spark):
    s = K.TreeSetting(resolution=0.05)
    a = np.linspace(-np.pi, np.pi, 720)
    pts = spark.createDataFrame([(0, i, float(1 + 2 * np.cos(t)), float(2 * np.sin(t)), 1.0, 0.0) for i, t in enumerate(a)], "frame int, pt_idx int, x double, y double, ox double, oy double")
    leaves = tree.insert_scans(pts, ["x", "y"], ["ox", "oy"], s)
    shot = spark.createDataFrame([(i, 1.0, 0.0, float(np.cos(i / 50)), float(np.sin(i / 50))) for i in range(314)], "ray int, x double, y double, vx double, vy double")
    hits = rays.cast_rays(shot, "ray", leaves, s, ["x", "y"], ["vx", "vy"], 6.0)
    r = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("d")).first()
    assert r.n == 314 and r.d == pytest.approx(2.0, abs=0.05)


def test_ellipse_lines(spark):
    f = lambda p, q: [c.alias(f"t{i}") for i, c in enumerate(G.line_ellipsoid([F.lit(v) for v in p], [F.lit(v) for v in q], [2.0, 1.0]))]
    assert tuple(spark.range(1).select(*f((-3.0, 1.0), (3.0, 1.0))).first()) == (0.5, 0.5)
    assert tuple(spark.range(1).select(*f((-3.0, 0.0), (3.0, 0.0))).first()) == (pytest.approx(1 / 6), pytest.approx(5 / 6))
    assert tuple(spark.range(1).select(*f((-3.0, 1.1), (3.0, 1.0))).first()) == (None, None)


def test_all_euler_orders_are_rotations(spark):
    every = [F.array(*[F.array(*row) for row in G.euler_matrix(order, [0.3, -0.7, 1.1])]).alias(order) for order in G.EULER_ORDERS]
    for m in spark.range(1).select(*every).first():
        r = np.array([list(x) for x in m])
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    assert len(G.EULER_ORDERS) == 24


def test_signed_distance_of_a_square(spark):
    v = spark.createDataFrame([(0, 0, -1.0, -1.0), (0, 1, 1.0, -1.0), (0, 2, 1.0, 1.0), (0, 3, -1.0, 1.0)], "obj_id int, vid int, x double, y double")
    lines = surface.close_polygons(v)
    p = spark.createDataFrame([(0, 0.0, 0.5), (1, 3.0, 0.0), (2, 2.0, 2.0)], "id int, x double, y double")
    got = {r.id: r.sdf for r in surface.signed_distance(p, "id", lines).collect()}
    assert got == {0: pytest.approx(-0.5), 1: pytest.approx(2.0), 2: pytest.approx(math.sqrt(2))}
    r = p.select("*", F.lit(-1.0).alias("vx"), F.lit(0.0).alias("vy"))
    d = {x.id: x.distance for x in surface.directional_distance(r, "id", lines).collect()}
    assert d == {0: pytest.approx(1.0), 1: pytest.approx(2.0), 2: math.inf}


def test_marching_squares_of_a_disc(spark):
    g = surface.grid_points(spark.range(1), 41, 41, -2.0, -2.0, 0.1).select("row", "col", (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 1.2).alias("value"))
    s = mesh.marching_squares(g, 0.0)
    length = s.agg(F.sum(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)) * 0.1).first()[0]
    assert length == pytest.approx(2 * math.pi * 1.2, rel=0.01)
    chains = mesh.chain_segments(s.withColumn("m", F.lit(1).cast("long")), "m")
    assert chains.select("obj_id").distinct().count() == 1


def test_marching_cubes_of_a_sphere(spark):
    n, step = 21, 0.15
    g = spark.range(n**3).select((F.col("id") % n).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), F.floor(F.col("id") / n / n).cast("int").alias("k"))
    g = g.withColumn("value", F.sqrt(sum(((F.col(c) * step - 1.5) ** 2 for c in "ijk"), F.lit(0.0))) - 1.0)
    v, f = mesh.mesh_of(mesh.marching_cubes(g, (-1.5, -1.5, -1.5), step))
    p = np.array([list(r)[1:] for r in v.orderBy("vid").collect()])
    t = np.array([list(r)[1:] for r in f.collect()])
    assert abs(np.linalg.norm(p, axis=1) - 1).max() < 0.01
    edges = {}
    for a, b, c in t:
        for e in ((a, b), (b, c), (c, a)):
            edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1
    assert set(edges.values()) == {2} and len(p) - len(edges) + len(t) == 2
    volume = abs(np.einsum("ij,ij->i", p[t[:, 0]], np.cross(p[t[:, 1]], p[t[:, 2]])).sum() / 6)
    assert volume == pytest.approx(4 / 3 * math.pi, rel=0.02)


def test_every_cube_case_is_closed():
    cases = mesh.cube_cases()
    assert len(cases) == 256 and not cases[0] and not cases[255]
    for k, triangles in enumerate(cases):
        crossed = {i for i, (a, b) in enumerate(mesh.EDGES) if (k >> a & 1) != (k >> b & 1)}
        assert {e for t in triangles for e in t} == crossed


def test_hull_and_visibility(spark):
    r = np.random.default_rng(3)
    p = np.concatenate([r.normal(size=(200, 3)) * 0.3, np.array([[x, y, z] for x in (-2, 2) for y in (-2, 2) for z in (-2, 2)])])
    f = mesh.hull_faces(p)
    assert set(f.ravel().tolist()) == set(range(200, 208))
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert (np.einsum("ij,kj->ik", n, p) - np.einsum("ij,ij->i", n, p[f[:, 0]])[:, None]).max() < 1e-9
    wall = [(0, i, float(x), float(y), 5.0) for i, (x, y) in enumerate((a, b) for a in range(-3, 4) for b in range(-3, 4))] + [(0, 100, 0.1, 0.1, 9.0)]
    seen = {x.pt_idx for x in mesh.visible_points(spark.createDataFrame(wall, "view long, pt_idx long, x double, y double, z double"), "view").collect()}
    assert 100 not in seen and len(seen) > 40


def test_ear_clipping_keeps_the_area():
    outer = np.array([[0, 0], [6, 0], [6, 4], [3, 1.5], [0, 4]], float)
    hole = np.array([[1, 0.5], [1, 1], [2, 1], [2, 0.5]], float)
    p = np.concatenate([outer, hole])
    area = sum(abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])) / 2 for a, b, c in mesh.ear_clip(outer, [hole]))
    assert area == pytest.approx(24 - 7.5 - 0.5)


def test_hilbert_map_learns_and_its_gradient_is_right():
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, (400, 2))
    y = (np.hypot(*x.T) < 1).astype(float)
    g = np.stack(np.meshgrid(*[np.linspace(-2, 2, 9)] * 2), -1).reshape(-1, 2)
    for diagonal in (True, False):
        m = hilbert.HilbertMap.blank(g, 0.4, diagonal)
        m.update(x, y, 4)
        assert ((m.predict(x) > 0.5) == y).mean() > 0.85
        at, h = np.array([[0.3, 0.8]]), 1e-5
        want = [(m.predict(at + d) - m.predict(at - d))[0] / (2 * h) for d in (np.array([h, 0]), np.array([0, h]))]
        assert np.allclose(m.gradient(at)[0], want, rtol=1e-4)


def test_radius_and_nearest(spark):
    r = np.random.default_rng(7)
    p = r.uniform(-3, 3, (80, 2))
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id int, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).T)
    got = {(x.query, x.point) for x in neighbors.radius_join(df, df, "id", "id", ["x", "y"], 0.8).collect()}
    assert got == {(i, j) for i in range(80) for j in range(80) if d[i, j] <= 0.8}
    near = {(x.query, x.rank): x.distance for x in neighbors.knn_join(df, df, "id", "id", ["x", "y"], 3, 0.3).collect()}
    assert all(near[i, k + 1] == pytest.approx(np.sort(d[i])[k]) for i in range(80) for k in range(3))


def test_nearest_among_dense_points_makes_few_pairs(spark, monkeypatch):
    """20,000 points within few cells of the given width, many of one place, and queries in it, far from it and nowhere."""
    points = spark.range(20000).select("id", F.expr("id * 7919 % 101 / 128d").alias("x"), F.expr("id * 104729 % 97 / 128d").alias("y"))
    asked = [(i, i * 37 % 90 / 128, i * 53 % 90 / 128) for i in range(150)] + [(150, 1.7, -0.4), (151, float("nan"), 0.0), (152, None, 0.0)]
    queries = spark.createDataFrame(asked, "q long, x double, y double")
    joined, pairs = neighbors.radius_join, []
    monkeypatch.setattr(neighbors, "radius_join", lambda left, *a: pairs.append((left, *a)) or joined(left, *a))
    got = {(r.query, r.rank): (r.distance, r.point) for r in neighbors.knn_join(queries, points, "q", "id", ["x", "y"], 5, 0.5).collect()}
    rows = [tuple(r) for r in points.collect()]
    want = {(i, n + 1): t for i, x, y in asked[:151] for n, t in enumerate(sorted((math.sqrt((u - x) ** 2 + (v - y) ** 2), p) for p, u, v in rows)[:5])}
    assert got == want
    assert joined(*pairs[0]).count() < 150 * 200


def test_masks(spark):
    c = spark.createDataFrame([(i, j) for i in range(5) for j in range(5)], "row int, col int")
    assert gridmap.erode(c).count() == 9 and gridmap.dilate(c).count() == 49 and gridmap.closing(c).count() == 25


def test_range_partitions_and_breaks(spark):
    r = [(0, i, i * 0.1, v) for i, v in enumerate([1.0, 1.1, 1.2, math.inf, 1.0, 1.1, 9.0, 9.1, 9.2])]
    df = spark.createDataFrame(r, "frame_id int, ray_idx int, angle double, range double")
    marked = sensors.mark_breaks(df, 0.5, 20.0, factor=5.0)
    assert [x.broken for x in marked.orderBy("ray_idx").collect()][-1]
    parts = sensors.partition_rays(marked, 0.5, 20.0, 2).orderBy("first").collect()
    assert [(p.first, p.last) for p in parts] == [(0, 2), (4, 5), (6, 8)]


def test_breaks_of_a_long_frame(spark):
    """A frame of more rays than a batch holds, with unknown, infinite and equal values, beside short ones; no frame is gathered in an array."""
    rng = np.random.default_rng(4)
    long = [(0, i, i * 0.01, float(v)) for i, v in enumerate(np.exp(rng.normal(0, 2, 25000)).round(3))]
    for i, v in ((7, None), (900, math.inf), (901, math.inf), (12000, math.nan), (20001, -math.inf)):
        long[i] = (*long[i][:3], v)
    long[15000] = (0, 15000, long[14999][2], 3.0)
    rows = [*long, (1, 4, 0.5, 2.0), (2, 0, 0.1, 1.0), (2, 1, 0.2, 9.0), (2, 3, 0.3, 90.0), (None, 1, 0.1, 1.0), (None, 2, 0.2, 5.0), (3, 0, 0.0, math.inf), (3, 1, 0.1, 1.0), (3, 2, 0.2, 2.0)]
    want = {}
    for f in {r[0] for r in rows}:
        mine, mean = sorted((r for r in rows if r[0] == f), key=lambda r: r[1]), None
        for (_, i, a, r), (_, _, b, t) in zip(mine, mine[1:]):
            slope = 0.0 if r is None or t is None or a == b else abs((t - r) / (b - a))
            slope = math.inf if math.isnan(slope) else slope
            mean = slope if mean is None else mean
            want[f, i] = slope > 10 * mean
            mean = mean if slope == math.inf else 0.9 * mean + (1 - 0.9) * slope
        want[f, mine[-1][1]] = True
    found = sensors.mark_breaks(spark.createDataFrame(rows, "frame_id int, ray_idx int, angle double, range double"), 0.5, 20.0)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == len(rows) and {(r.frame_id, r.ray_idx): r.broken for r in got} == want and 100 < sum(want.values()) < 24000
    assert dict(found.dtypes) == {"frame_id": "int", "ray_idx": "int", "angle": "double", "range": "double", "broken": "boolean"}


def test_rays_through_an_edge_meet_its_faces(spark):
    """Rounding put the first beyond the edge for both faces there; the others pass beside the edge or aim at edges."""
    from orbweave.plans.space import BOX, HALF, _box

    v = np.array([0.6, -0.48, 0.64])
    rows = [(0, -2.9375, 4.03125, -2.375, *v), (1, -2.9375, 4.03125 + 1e-6, -2.375, *v), (2, -2.9375, 4.03125 - 1e-6, -2.375, *v)]
    corners = (2 * (np.arange(8)[:, None] >> np.arange(3) & 1) - 1) * np.array(HALF)
    for a, b in sorted({(min(f[i - 1], f[i]), max(f[i - 1], f[i])) for f in BOX for i in range(3)}):
        for share in np.arange(1, 24) / 24:
            at = corners[a] + (corners[b] - corners[a]) * share
            rows.append((len(rows), *(at + np.array([3.1, 7.7, -5.3])), -3.1, -7.7, 5.3))
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "id int, x double, y double, z double, vx double, vy double, vz double")
    got = {r.id: r.range for r in sensors.scan_mesh(df, "id", *_box(spark)).collect()}
    assert got[0] == pytest.approx(5.2734375, abs=1e-12) and got[1] == math.inf and got[2] == pytest.approx(5.2734375, abs=1e-5)
    assert len(got) == len(rows) and all(got[i] <= 1 + 1e-9 for i in range(3, len(rows)))


def test_hiding_elevations_without_pairs_of_all_points(spark):
    """As the comparison of all pairs, also in blocks, with columns, equal points, hits of a number twice and rays elsewhere than their hits."""
    rng = np.random.default_rng(3)
    rays = [(f, i, *map(float, rng.integers(-12, 12, 3) / 4)) for f in range(2) for i in range(700)] + [(2, 0, 0.0, 0.0, 0.0), (3, None, 0.0, 0.0, 0.0), (0, 900, None, 0.0, 9.0)]
    hits = [(f, i, x, y, z + (0.25 if i % 3 == 0 else 0.0)) for f, i, x, y, z in rays if i is not None and x is not None] + [(0, 5, 9.0, 9.0, -4.0), (1, 5000, 0.0, 0.0, -9.0)]
    want = {}
    for f, i, x, y, z in hits:
        for g, j, u, v, w in rays:
            if f == g and i != j and j is not None and u is not None:
                r = math.sqrt((u - x) ** 2 + (v - y) ** 2 + (w - z) ** 2)
                at = (f, i, min(6, math.floor((math.atan2(v - y, u - x) + math.pi) / (2 * math.pi / 7))))
                want[at] = max(want.get(at, -9.0), math.asin((w - z) / r) if r else 0.0)
    types = "frame_id int, ray_idx int, x double, y double, z double"
    for more in ({}, {"block": 300, "ask": 200}):
        found = sensors.occlusion_sample(spark.createDataFrame(hits, types), spark.createDataFrame(rays, types), 7, **more)
        got = found.collect()
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and len(got) == len(want)
        assert all(abs(want[r.frame_id, r.ray_idx, r.segment] - r.elevation) < 1e-12 for r in got)
    assert dict(found.dtypes) == {"frame_id": "int", "ray_idx": "int", "segment": "int", "elevation": "double"}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "r1", "bbox": {"min": [0, 0], "max": [10, 20]},\n "verts": [[0, 0], [10, 0], [10, 20]]}')
    rooms = maps.read_rooms(spark, str(tmp_path / "a.json"))
    assert maps.room_vertices(rooms).count() == 3 and maps.room_size_statistics(rooms).first().bucket == 200
    (tmp_path / "m.map").write_text("type octile\nheight 2\nwidth 3\nmap\n.@G\nT..\n")
    assert maps.read_street_map(spark, str(tmp_path / "m.map")).filter("passable").count() == 4
    (tmp_path / "s.scen").write_text("version 1\n0\tx.map\t3\t2\t0\t0\t2\t1\t2.5\n")
    assert maps.read_scenes(spark, str(tmp_path / "s.scen")).first().optimal_length == 2.5
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    assert maps.read_ply_vertices(spark, str(tmp_path / "p.ply")).count() == 4 and maps.read_ply_faces(spark, str(tmp_path / "p.ply")).count() == 2
    (tmp_path / "t.csv").write_text("1,2,0.5\n3,4,1.5\n")
    assert maps.pose_matrix(maps.read_trajectory(spark, str(tmp_path / "t.csv"), "se2"), "se2").count() == 2
    leaves = cells(spark, [(5, 6), (7, 8)])
    maps.write_tree(leaves, S2, str(tmp_path / "tree"))
    back, s = maps.read_tree(spark, str(tmp_path / "tree"))
    assert s == S2 and tree.same_tree(back, leaves)


def test_snapshots_equal_one_build(spark, tmp_path):
    s = K.TreeSetting()
    rows = [(f, k % 5, k % 3, 0.85 if (f + k) % 3 else -0.4) for f in range(6) for k in range(7)]
    df = spark.createDataFrame(rows, "frame long, kx int, ky int, delta double").groupBy("frame", "kx", "ky").agg(F.max("delta").alias("delta"))
    shots = Snapshots(spark, str(tmp_path), s)
    shots.merge(df.filter("frame < 3"), 0)
    shots.merge(df.filter("frame >= 3"), 1)
    a = {(r.kx, r.ky): r.log_odds for r in shots.read(1).collect()}
    b = {(r.kx, r.ky): r.log_odds for r in tree.update_cells(df, s, ["frame"]).collect()}
    assert a == pytest.approx(b)


FAST = ["map_from_hits", "morton_codes", "ordered_updates", "insert_scans", "search_leaves", "cast_rays", "signed_distances", "points_within_radius", "hysteresis_map", "leaf_neighbours"]


@pytest.mark.parametrize("name", FAST)
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "supplier", "nation", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = Q.QUERIES[name](spark, sf_dir)
    answer = con.execute(Q.SQL[name])
    at = [[d[0] for d in answer.description].index(c) for c in got.columns]
    order = lambda rows: sorted((tuple(round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in range(len(r))) for r in rows), key=str)
    assert order(tuple(r) for r in got.collect()) == order(tuple(r[i] for i in at) for r in answer.fetchall())


def test_keys_of_coordinates_beyond_the_tree(spark):
    from orbweave.functions import keys

    s = keys.TreeSetting(resolution=0.25, depth=8)
    values = [1e9, 1e300, float("inf"), float("-inf"), float("nan"), None, -32.0, 31.99, 32.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.k for r in df.select(keys.checked_key("x", s).alias("k")).collect()] == [None] * 6 + [0, 255, None]
    rays_df = df.select(F.lit(0.1).alias("a"), F.lit(0.1).alias("b"), F.col("x").alias("c"), F.lit(0.2).alias("d"))
    assert rays.ray_cells(rays_df, ["a", "b"], ["c", "d"], s).select("c").distinct().count() == 2


def test_large_surfaces_meet_through_cells(spark, monkeypatch):
    from orbweave.operators import surface
    from orbweave.plans.tables import lines, marks

    def answers():
        p, wall = marks(spark, "/root/testdata/sf0.001"), lines(spark, "/root/testdata/sf0.001")
        inside = sorted(tuple(r) for r in surface.points_in_polygons(p, "pt_idx", wall).collect())
        return inside, {r.pt_idx: (round(r.sdf, 9), r.obj_id, r.line_id) for r in surface.signed_distance(p, "pt_idx", wall).collect()}

    few = answers()
    monkeypatch.setattr(surface, "BROADCAST", 0)
    assert answers() == few


def test_late_frames_of_a_stream(spark, tmp_path):
    from orbweave.streaming.ingest import Snapshots, stateful_cells

    s = K.TreeSetting(resolution=0.25, depth=8)
    batches = [[(1, 5, 5, 0.85), (3, 5, 5, 0.85), (3, 6, 5, -0.4)], [(2, 5, 5, -9.0), (4, 5, 5, -0.4), (4, 6, 5, -0.4)]]
    schema = "frame long, kx int, ky int, delta double"
    kept = Snapshots(spark, str(tmp_path / "map"), s)
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, schema)
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        kept.merge(df, i)
    want = {(5, 5): (1.3, 4), (6, 5): (-0.8, 4)}
    assert {(r.kx, r.ky): (round(r.log_odds, 6), r.frame) for r in kept.read(1).collect()} == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stateful_cells(stream, s).writeStream.format("memory").queryName("cells").outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("cells").orderBy("frame").collect():
        last[r.kx, r.ky] = (round(r.log_odds, 6), r.frame)
    assert last == want and spark.table("cells").agg(F.sum("late")).first()[0] == 1


def test_frames_are_numbered_over_many_splits(spark, tmp_path):
    from orbweave.sources import maps

    (tmp_path / "t.csv").write_text("# poses\n" + "\n".join(f"{i},{i * 2}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = maps.read_trajectory(spark, str(tmp_path / "t.csv"), "2d").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.frame_id, r.tx) for r in got) == [(i, float(i)) for i in range(5000)]
