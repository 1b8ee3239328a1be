"""Queries in space: scans, meshes, contours, hulls, sensors and learned maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import hilbert, mesh, rays, sensors, tree
from orbweave.plans.queries import _M, T, _key, query, r6
from orbweave.plans.tables import marks, table

# scans


def _rays3_sql(src: str, name: str = "") -> str:
    """Cells of rays (ray, sx to ez) in space, without the end's; ties x, y, z."""
    axes = [("x", 0), ("y", 1), ("z", 2)]
    keys = ", ".join(f"{_key(f's{a}', 0.25, 128)} AS at_{a}, {_key(f'e{a}', 0.25, 128)} AS to_{a}" for a, _ in axes)
    crossed = " UNION ALL ".join(f"SELECT ray, {n} AS axis, ((at_{a} - 128 + CASE WHEN to_{a} >= at_{a} THEN 1 ELSE 0 END + CASE WHEN to_{a} >= at_{a} THEN i ELSE -i END) * 0.25 - s{a}) / (e{a} - s{a}) AS t FROM k{name}, unnest(range(0, abs(to_{a} - at_{a}))) AS u(i)" for a, n in axes)
    counts = ", ".join(f"sum(CASE WHEN axis = {n} THEN 1 ELSE 0 END) OVER o AS n{a}" for a, n in axes)
    cells = ", ".join(f"CAST(at_{a} + CASE WHEN to_{a} >= at_{a} THEN n{a} ELSE -n{a} END AS INTEGER) AS k{a}" for a, _ in axes)
    return f"""k{name} AS (SELECT *, {keys} FROM {src}), c{name} AS ({crossed}), w{name} AS (SELECT ray, row_number() OVER o AS step, {counts}, count(*) OVER (PARTITION BY ray) AS n FROM c{name} WINDOW o AS (PARTITION BY ray ORDER BY t, axis)),
s{name} AS (SELECT DISTINCT ray, 0 AS step, 0 AS nx, 0 AS ny, 0 AS nz, n FROM w{name} UNION ALL SELECT ray, step, nx, ny, nz, n FROM w{name}),
cells{name} AS (SELECT k{name}.ray, CAST(step AS INTEGER) AS step, {cells}, s{name}.n FROM s{name} JOIN k{name} ON k{name}.ray = s{name}.ray)"""


_RAYS3 = f"{_M}, r AS (SELECT pt_idx AS ray, frame, 0.1::DOUBLE AS sx, -0.17::DOUBLE AS sy, 0.06::DOUBLE AS sz, x / 4 + 0.011::DOUBLE AS ex, y / 4 + 0.007::DOUBLE AS ey, z / 4 + 0.003::DOUBLE AS ez FROM m), {_rays3_sql('r')}"


def _rays3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select("frame", "pt_idx", F.lit(0.1).alias("ox"), F.lit(-0.17).alias("oy"), F.lit(0.06).alias("oz"), (F.col("x") / 4 + 0.011).alias("x"), (F.col("y") / 4 + 0.007).alias("y"), (F.col("z") / 4 + 0.003).alias("z"))


@query(f"WITH {_RAYS3} SELECT ray, step, kx, ky, kz FROM cells WHERE step < n")
def ray_traversal_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rays3(spark, sf_dir).select(F.col("pt_idx").alias("ray"), "ox", "oy", "oz", "x", "y", "z")
    return rays.ray_cells(r, ["ox", "oy", "oz"], ["x", "y", "z"], T).select("ray", "step", "kx", "ky", "kz")


_SCAN3 = f"""{_RAYS3}, h AS (SELECT frame, {_key('ex', 0.25, 128)} AS kx, {_key('ey', 0.25, 128)} AS ky, {_key('ez', 0.25, 128)} AS kz, 1 AS hit FROM r UNION ALL SELECT frame, kx, ky, kz, 0 FROM cells JOIN r ON r.ray = cells.ray WHERE step < n),
u AS (SELECT frame, kx, ky, kz, CASE WHEN max(hit) = 1 THEN 0.85::DOUBLE ELSE -0.4::DOUBLE END AS delta FROM h GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame) AS n FROM u),
f AS (SELECT kx, ky, kz, n, least(3.5, greatest(-2.0, delta)) AS l FROM o WHERE n = 1 UNION ALL SELECT o.kx, o.ky, o.kz, o.n, least(3.5, greatest(-2.0, f.l + o.delta)) FROM f JOIN o ON o.kx = f.kx AND o.ky = f.ky AND o.kz = f.kz AND o.n = f.n + 1),
t AS (SELECT kx, ky, kz, arg_max(l, n) AS log_odds FROM f GROUP BY kx, ky, kz)"""


def _scanned3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.insert_scans(_rays3(spark, sf_dir), ["x", "y", "z"], ["ox", "oy", "oz"], T)


@query(f"WITH RECURSIVE {_SCAN3} SELECT kx, ky, kz, round(log_odds, 6) AS log_odds FROM t")
def insert_scans_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned3(spark, sf_dir).select("kx", "ky", "kz", r6("log_odds"))


_CAST3 = f"""{_SCAN3}, r2 AS (SELECT s_suppkey AS ray, 0.03::DOUBLE AS sx, 0.02::DOUBLE AS sy, 0.01::DOUBLE AS sz, 0.03::DOUBLE + cos(s_suppkey * 0.37::DOUBLE + 0.1::DOUBLE) / sqrt(1.25::DOUBLE) * 4.5 AS ex, 0.02::DOUBLE + sin(s_suppkey * 0.37::DOUBLE + 0.1::DOUBLE) / sqrt(1.25::DOUBLE) * 4.5 AS ey, 0.01::DOUBLE + 0.5 / sqrt(1.25::DOUBLE) * 4.5 AS ez FROM supplier), {_rays3_sql('r2', '2')},
g AS (SELECT c.ray, c.step, c.kx, c.ky, c.kz, sqrt(pow((c.kx - 127.5) * 0.25 - 0.03::DOUBLE, 2) + pow((c.ky - 127.5) * 0.25 - 0.02::DOUBLE, 2) + pow((c.kz - 127.5) * 0.25 - 0.01::DOUBLE, 2)) AS distance FROM cells2 c JOIN t ON t.kx = c.kx AND t.ky = c.ky AND t.kz = c.kz AND t.log_odds >= 0)"""


@query(f"WITH RECURSIVE {_CAST3}, b AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY step) AS n FROM g WHERE distance <= 4 OR step = 0) SELECT ray, step, kx, ky, kz, round(distance, 6) AS distance FROM b WHERE n = 1")
def cast_rays_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("s_suppkey") * 0.37 + 0.1
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ray"), F.lit(0.03).alias("sx"), F.lit(0.02).alias("sy"), F.lit(0.01).alias("sz"), F.cos(a).alias("vx"), F.sin(a).alias("vy"), F.lit(0.5).alias("vz"))
    return rays.cast_rays(r, "ray", _scanned3(spark, sf_dir), T, ["sx", "sy", "sz"], ["vx", "vy", "vz"], 4.0).select("ray", "step", "kx", "ky", "kz", r6("distance"))


# meshes

#: A box of half sizes 2, 1.5 and 1, its corners by bits of their number, its faces turned outward.
HALF = (2.0, 1.5, 1.0)
BOX = [(0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6)]


def _box(spark: SparkSession, inward: bool = False) -> tuple[DataFrame, DataFrame]:
    v = spark.createDataFrame([(i, *[(2 * (i >> k & 1) - 1) * h for k, h in enumerate(HALF)]) for i in range(8)], "vid int, x double, y double, z double")
    f = spark.createDataFrame([(i, a, *((c, b) if inward else (b, c))) for i, (a, b, c) in enumerate(BOX)], "fid int, a int, b int, c int")
    return v, f


_Q = "q AS (SELECT pt_idx, x, y, z, abs(x) - 2 AS qx, abs(y) - 1.5::DOUBLE AS qy, abs(z) - 1 AS qz FROM m)"


@query(f"WITH {_M}, {_Q} SELECT pt_idx, round(CASE WHEN greatest(qx, qy, qz) <= 0 THEN greatest(qx, qy, qz) ELSE sqrt(pow(greatest(qx, 0), 2) + pow(greatest(qy, 0), 2) + pow(greatest(qz, 0), 2)) END, 6) + 0.0 AS sdf FROM q")
def mesh_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box's faces come turned inward and are turned over first."""
    v, f = _box(spark, inward=True)
    return mesh.mesh_distance(marks(spark, sf_dir), "pt_idx", v, mesh.outward(v, f)).select("pt_idx", (F.round("sdf", 6) + 0.0).alias("sdf"))


@query(f"WITH {_M}, {_Q} SELECT pt_idx FROM q WHERE greatest(qx, qy, qz) <= 0")
def points_in_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_contains(marks(spark, sf_dir), "pt_idx", *_box(spark))


@query("SELECT 52.0::DOUBLE AS area, 12::BIGINT AS faces, -2.0::DOUBLE AS min_x, 2.0::DOUBLE AS max_x, -1.5::DOUBLE AS min_y, 1.5::DOUBLE AS max_y, -1.0::DOUBLE AS min_z, 1.0::DOUBLE AS max_z")
def mesh_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_summary(*_box(spark))


_FACE = "f AS (SELECT CAST(i AS INTEGER) AS fid, i // 4 AS axis, CASE WHEN i // 2 % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, CASE i // 4 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 4.0 ELSE 6.0 END AS area FROM range(12) AS r(i))"


@query(f"WITH {_FACE} SELECT fid, area, sum(area) OVER (ORDER BY fid) AS total, CASE WHEN axis = 0 THEN side ELSE 0 END AS nx, CASE WHEN axis = 1 THEN side ELSE 0 END AS ny, CASE WHEN axis = 2 THEN side ELSE 0 END AS nz FROM f")
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _box(spark)
    return mesh.cumulative_areas(v, f, 5).join(mesh.face_measures(v, f).select("fid", *[(F.col(f"n{x}") + 0.0).alias(f"n{x}") for x in "xyz"]), "fid")


@query(f"""WITH {_M}, s AS (SELECT pt_idx, (-2 - x) / 0.6::DOUBLE AS ax, (2 - x) / 0.6::DOUBLE AS bx, (-1.5 - y) / -0.48::DOUBLE AS ay, (1.5 - y) / -0.48::DOUBLE AS b_y, (-1 - z) / 0.64::DOUBLE AS az, (1 - z) / 0.64::DOUBLE AS bz FROM m),
n AS (SELECT pt_idx, greatest(least(ax, bx), least(ay, b_y), least(az, bz)) AS near, least(greatest(ax, bx), greatest(ay, b_y), greatest(az, bz)) AS far FROM s) SELECT pt_idx, round(CASE WHEN near <= far AND far >= 0 THEN CASE WHEN near >= 0 THEN near ELSE far END ELSE 1e9 END, 6) AS range FROM n""")
def scan_of_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = marks(spark, sf_dir).withColumns({"vx": F.lit(0.6), "vy": F.lit(-0.48), "vz": F.lit(0.64)})
    return sensors.scan_mesh(p, "pt_idx", *_box(spark)).select("pt_idx", r6(F.least(F.lit(1e9), F.col("range")), "range"))


@query("SELECT 'on the surface' AS holds, true AS yes UNION ALL SELECT 'as many as asked for', true")
def samples_of_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _box(spark)
    drawn = mesh.sample_surface(v, f, 400, 5).withColumn("id", F.monotonically_increasing_id())
    d = mesh.mesh_distance(drawn, "id", v, f)
    far = d.agg(F.lit("on the surface").alias("holds"), (F.max(F.abs("sdf")) < 1e-9).alias("yes"))
    return far.unionByName(d.agg(F.lit("as many as asked for").alias("holds"), F.abs(F.count(F.lit(1)) - 400).between(0, 12).alias("yes")))


# contours

_FIELD = "g AS (SELECT r, c, ((r * 7 + c * 13) % 11 - 4.5::DOUBLE) AS v FROM (SELECT unnest(range(0, 40)) AS r), (SELECT unnest(range(0, 50)) AS c))"


@query(f"""WITH {_FIELD}, s AS (SELECT a.r, a.c, a.v AS v0, b.v AS v1, d.v AS v2, e.v AS v3 FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g d ON d.r = a.r + 1 AND d.c = a.c + 1 JOIN g e ON e.r = a.r + 1 AND e.c = a.c),
x AS (SELECT *, list_filter([0, 1, 2, 3], lambda i: CASE i WHEN 0 THEN (v0 <= 0) <> (v1 <= 0) WHEN 1 THEN (v1 <= 0) <> (v2 <= 0) WHEN 2 THEN (v2 <= 0) <> (v3 <= 0) ELSE (v3 <= 0) <> (v0 <= 0) END) AS e FROM s),
p AS (SELECT *, unnest(CASE WHEN len(e) = 2 THEN [[e[1], e[2]]] WHEN len(e) = 4 AND v0 <= 0 THEN [[0, 3], [1, 2]] WHEN len(e) = 4 THEN [[0, 1], [2, 3]] ELSE [] END) AS ab FROM x),
q AS (SELECT r, c, ab, [c + abs(v0) / (abs(v0) + abs(v1)), c + 1, c + 1 - abs(v2) / (abs(v2) + abs(v3)), c] AS xs, [r, r + abs(v1) / (abs(v1) + abs(v2)), r + 1, r + 1 - abs(v3) / (abs(v3) + abs(v0))] AS ys FROM p)
SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(xs[ab[1] + 1], 6) AS x1, round(ys[ab[1] + 1], 6) AS y1, round(xs[ab[2] + 1], 6) AS x2, round(ys[ab[2] + 1], 6) AS y2 FROM q""")
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(2000).select(F.expr("cast(id div 50 as int)").alias("row"), F.expr("cast(id % 50 as int)").alias("col")).withColumn("value", (F.col("row") * 7 + F.col("col") * 13) % 11 - 4.5)
    return mesh.marching_squares(g, 0.0).select("row", "col", r6("x1"), r6("y1"), r6("x2"), r6("y2"))


_CUBE = "g AS (SELECT i, j, k, ((i * 7 + j * 11 + k * 5) % 13 - 6.3::DOUBLE) AS v FROM (SELECT unnest(range(0, 14)) AS i), (SELECT unnest(range(0, 13)) AS j), (SELECT unnest(range(0, 12)) AS k))"


def _cubes(spark: SparkSession) -> DataFrame:
    g = spark.range(14 * 13 * 12).select(F.expr("cast(id div 156 as int)").alias("i"), F.expr("cast(id div 12 % 13 as int)").alias("j"), F.expr("cast(id % 12 as int)").alias("k"))
    return mesh.marching_cubes(g.withColumn("value", (F.col("i") * 7 + F.col("j") * 11 + F.col("k") * 5) % 13 - 6.3))


@query(f"""WITH {_CUBE}, e AS (SELECT a.i, a.j, a.k, n AS axis, a.v AS va, b.v AS vb FROM g a, range(3) AS u(n), g b WHERE b.i = a.i + CASE WHEN n = 0 THEN 1 ELSE 0 END AND b.j = a.j + CASE WHEN n = 1 THEN 1 ELSE 0 END AND b.k = a.k + CASE WHEN n = 2 THEN 1 ELSE 0 END AND (a.v < 0) <> (b.v < 0))
SELECT CAST(row_number() OVER (ORDER BY i, j, k, axis) - 1 AS INTEGER) AS vid, round(i + CASE WHEN axis = 0 THEN va / (va - vb) ELSE 0 END, 6) AS x, round(j + CASE WHEN axis = 1 THEN va / (va - vb) ELSE 0 END, 6) AS y, round(k + CASE WHEN axis = 2 THEN va / (va - vb) ELSE 0 END, 6) AS z FROM e""")
def cube_surface_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_of(_cubes(spark))[0].select("vid", r6("x"), r6("y"), r6("z"))


@query("SELECT 0::BIGINT AS holes, true AS numbered")
def cube_surface_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ball's surface: each side of a triangle is another triangle's the other way around, and faces are numbered without gaps."""
    g = spark.range(12**3).select(F.expr("cast(id div 144 as int)").alias("i"), F.expr("cast(id div 12 % 12 as int)").alias("j"), F.expr("cast(id % 12 as int)").alias("k"))
    ball = g.withColumn("value", F.sqrt((F.col("i") - 5.5) ** 2 + (F.col("j") - 5.4) ** 2 + (F.col("k") - 5.3) ** 2) - 4.1)
    _, faces = mesh.mesh_of(mesh.marching_cubes(ball))
    sides = faces.select(F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("s")).select("s.p", "s.q")
    open_sides = sides.select(F.col("q").alias("p"), F.col("p").alias("q")).exceptAll(sides)
    return open_sides.agg(F.count(F.lit(1)).alias("holes")).join(faces.agg((F.max("fid") + 1 == F.count(F.lit(1))).alias("numbered")))


# hulls and triangles


def _clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten points a group, no four in a plane."""
    m, n = marks(spark, sf_dir), F.col("pt_idx")
    return m.select(F.expr("pt_idx div 10").alias("grp"), "pt_idx", *[(F.col(c) + n * n % p * f).alias(c) for c, p, f in (("x", 97, 0.00137), ("y", 89, 0.00173), ("z", 83, 0.00119))])


_CLOUD = f"{_M}, p AS (SELECT pt_idx // 10 AS grp, pt_idx, x + pt_idx * pt_idx % 97 * 0.00137::DOUBLE AS x, y + pt_idx * pt_idx % 89 * 0.00173::DOUBLE AS y, z + pt_idx * pt_idx % 83 * 0.00119::DOUBLE AS z FROM m)"


def _hull_sql(src: str) -> str:
    side = "(u.x - a.x) * ((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)) + (u.y - a.y) * ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) + (u.z - a.z) * ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
    return f"""t AS (SELECT a.grp, a.pt_idx AS a, b.pt_idx AS b, c.pt_idx AS c, {side} AS s FROM {src} a JOIN {src} b ON a.grp = b.grp AND a.pt_idx < b.pt_idx JOIN {src} c ON c.grp = a.grp AND b.pt_idx < c.pt_idx JOIN {src} u ON u.grp = a.grp AND u.pt_idx NOT IN (a.pt_idx, b.pt_idx, c.pt_idx)),
hull AS (SELECT grp, a, b, c FROM t GROUP BY grp, a, b, c HAVING min(s) > 0 OR max(s) < 0)"""


@query(f"WITH {_CLOUD}, {_hull_sql('p')} SELECT grp, a, b, c FROM hull")
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mesh.convex_hull(_clouds(spark, sf_dir), "grp").select("grp", F.array_sort(F.array("a", "b", "c")).alias("t"))
    return found.select("grp", *[F.col("t")[i].alias(n) for i, n in enumerate("abc")])


@query(f"""WITH {_CLOUD}, z AS (SELECT *, sqrt(x * x + y * y + z * z) AS size, max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY grp) * 3 AS reach FROM p),
f AS (SELECT grp, pt_idx, x + 2 * (reach - size) * x / size AS x, y + 2 * (reach - size) * y / size AS y, z + 2 * (reach - size) * z / size AS z FROM z UNION ALL SELECT DISTINCT grp, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM p), {_hull_sql('f')}
SELECT * FROM (SELECT DISTINCT grp, unnest([a, b, c]) AS pt_idx FROM hull) WHERE pt_idx >= 0""")
def points_in_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.visible_points(_clouds(spark, sf_dir), "grp", factor=3.0)


_RING = "v AS (SELECT n_nationkey AS poly_id, i AS vid, (2 + (n_nationkey * 5 + i * 3) % 4) * cos(i * 2 * pi() / (5 + n_nationkey % 4)) AS x, (2 + (n_nationkey * 5 + i * 3) % 4) * sin(i * 2 * pi() / (5 + n_nationkey % 4)) AS y, 5 + n_nationkey % 4 AS n FROM nation, range(8) AS u(i) WHERE i < 5 + n_nationkey % 4), e AS (SELECT a.*, b.x AS bx, b.y AS b_y FROM v a JOIN v b ON a.poly_id = b.poly_id AND b.vid = (a.vid + 1) % a.n)"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), (F.col("n_nationkey") % 4 + 5).alias("n"))
    v = n.select("poly_id", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("vid"))
    a, r = F.col("vid") * (2 * np.pi) / F.col("n"), 2 + (F.col("poly_id") * 5 + F.col("vid") * 3) % 4
    return v.select("poly_id", F.lit(0).alias("ring"), "vid", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


@query(f"WITH {_RING} SELECT poly_id, max(n) - 2 AS triangles, round(abs(sum(x * b_y - bx * y)) / 2, 6) AS area FROM e GROUP BY poly_id")
def triangulated_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _rings(spark, sf_dir)
    t = mesh.triangulate(v)
    for c in "abc":
        t = t.join(v.select("poly_id", F.col("vid").cast("long").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["poly_id", c])
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return t.groupBy("poly_id").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(area), 6).alias("area"))


@query(f"WITH {_RING} SELECT poly_id, max(n) * 2 AS faces, round(sum(sqrt(pow(bx - x, 2) + pow(b_y - y, 2))) * 2.5, 6) AS area FROM e GROUP BY poly_id")
def extruded_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh.extrude(_rings(spark, sf_dir), 2.5, "poly_id")
    key = lambda c: (F.col("poly_id") * 100 + F.col(c)).alias(c)
    sized = mesh.face_measures(v.select(key("vid"), "x", "y", "z"), f.select(key("fid"), key("a"), key("b"), key("c")))
    return sized.groupBy(F.expr("fid div 100").alias("poly_id")).agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 6).alias("area"))


@query("SELECT i AS vid, round(sin(i // 16 / 8.0::DOUBLE * pi()) * cos(i % 16 / 16.0::DOUBLE * 2 * pi()) * 3, 6) + 0.0 AS x, round(sin(i // 16 / 8.0::DOUBLE * pi()) * sin(i % 16 / 16.0::DOUBLE * 2 * pi()) * 2, 6) + 0.0 AS y, round(cos(i // 16 / 8.0::DOUBLE * pi()), 6) + 0.0 AS z FROM range(144) AS r(i)")
def ellipsoid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mesh.ellipsoid_points(table(spark, sf_dir, "nation"), (3.0, 2.0, 1.0), 9, 16)
    return p.select("vid", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


# learned maps

HINGES = np.array([(x, y) for x in (-8.0, -4.0, 0.0, 4.0, 8.0) for y in (-6.0, -2.0, 2.0, 6.0)])


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir).select(F.col("frame").alias("map_id"), "x", "y", (F.col("pt_idx") % 3 == 0).cast("int").alias("label"))
    return hilbert.train_maps(m, "map_id", HINGES, 2.0, rounds=1)


_LEARN = f"""{_M}, h AS (SELECT i * 4 + j + 1 AS w, i * 4.0::DOUBLE - 8 AS hx, j * 4.0::DOUBLE - 6 AS hy FROM range(5) AS a(i), range(4) AS b(j)), f AS (SELECT frame, pt_idx, x, y, w, hx, hy, exp(-(pow(x - hx, 2) + pow(y - hy, 2)) / 8) AS phi FROM m, h UNION ALL SELECT frame, pt_idx, x, y, 0, x, y, 1.0::DOUBLE FROM m),
s AS (SELECT frame AS map_id, w, 1e-4::DOUBLE + sum(phi * phi) * (1 / (1 + exp(-1.0::DOUBLE)) - 0.5::DOUBLE) AS precision, sum(phi * (CASE WHEN pt_idx % 3 = 0 THEN 1 ELSE 0 END - 0.5::DOUBLE)) AS information FROM f GROUP BY 1, 2)"""


@query(f"WITH {_LEARN} SELECT map_id, CAST(w AS INTEGER) AS weight, round(information / precision, 6) AS mean, round(precision, 6) AS precision FROM s")
def learned_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).select("map_id", F.posexplode(F.arrays_zip("mean", "precision")).alias("weight", "s")).select("map_id", "weight", r6("s.mean", "mean"), r6("s.precision", "precision"))


@query(f"""WITH {_LEARN}, g AS (SELECT f.pt_idx, sum(phi * information / precision) AS h, sum(phi * phi / precision) AS v, sum(phi * (hx - x) / 4 * information / precision) AS dx, sum(phi * (hy - y) / 4 * information / precision) AS dy, 2 * sum(phi * (hx - x) / 4 * phi / precision) AS vx, 2 * sum(phi * (hy - y) / 4 * phi / precision) AS vy FROM f JOIN s ON s.w = f.w AND s.map_id = 3 GROUP BY f.pt_idx),
p AS (SELECT *, 1 + pi() / 8 * v AS c, 1 / (1 + exp(-h / sqrt(1 + pi() / 8 * v))) AS probability FROM g)
SELECT pt_idx AS point, round(probability, 6) AS probability, round((dx / sqrt(c) - 0.5 * pi() / 8 * h / pow(c, 1.5) * vx) * probability * (1 - probability), 6) + 0.0 AS gx, round((dy / sqrt(c) - 0.5 * pi() / 8 * h / pow(c, 1.5) * vy) * probability * (1 - probability), 6) + 0.0 AS gy FROM p""")
def learned_map_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hilbert.load_map(_trained(spark, sf_dir).filter("map_id = 3").first(), HINGES, 2.0)
    return hilbert.predict(marks(spark, sf_dir).select("pt_idx", "x", "y"), "pt_idx", m, gradient=True).select("point", r6("probability"), (F.round("gx", 6) + 0.0).alias("gx"), (F.round("gy", 6) + 0.0).alias("gy"))
