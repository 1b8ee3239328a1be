"""Queries in the plane over surfaces, frames, masks, cells and tree structure."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.operators import gridmap, neighbors, rays, sensors, surface, tree
from orbweave.plans.queries import _AT, _GRID, _K8, _L, _LEAVES, _M, _PRUNED, _RNG, _SEGT, _WIND, T, _blocky, _grid, _key, _queries, _ranges, _rays_sql, query, r6
from orbweave.plans.tables import lines, marks, table

# surfaces


@query(f"WITH {_L} SELECT obj_id, CAST(line_id AS INTEGER) AS line_id, ax, ay, bx, b_y AS by, CAST((line_id + 3) % 4 AS INTEGER) AS before, CAST((line_id + 1) % 4 AS INTEGER) AS after FROM l")
def closed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir).select("obj_id", F.col("line_id").alias("vid"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    around = surface.vertex_neighbours(v).select("obj_id", F.col("vid").alias("line_id"), "before", "after")
    return surface.close_polygons(v).join(around, ["obj_id", "line_id"]).select("obj_id", "line_id", "ax", "ay", "bx", "by", "before", "after")


@query(f"WITH {_L}, n AS (SELECT max(obj_id) + 1 AS n FROM l) SELECT obj_id, CAST(line_id AS INTEGER) AS line_id, ax, ay FROM l UNION ALL SELECT CAST(obj_id + n AS INTEGER), CAST(line_id AS INTEGER), ax + 1.5, ay - 2 FROM l, n")
def added_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = lines(spark, sf_dir)
    return surface.add_obstacles(ground, surface.translate(ground, 1.5, -2.0)).select("obj_id", "line_id", "ax", "ay")


def _normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals at the squares' corners, away from the middle in objects of even number, else toward it."""
    side = F.when(F.col("obj_id") % 2 == 0, 1.0).otherwise(-1.0) * 0.5
    return lines(spark, sf_dir).select("obj_id", "line_id", F.col("ax").alias("x"), F.col("ay").alias("y"), (side * F.when(F.col("line_id").isin(0, 3), -1).otherwise(1)).alias("nx"), (side * F.when(F.col("line_id").isin(0, 1), -1).otherwise(1)).alias("ny"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS obj_id, n_nationkey % 2 = 0 AS outside FROM nation")
def turned_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.outside_flags(_normals(spark, sf_dir))


@query(f"""WITH {_M}, {_L}, d AS (SELECT pt_idx, obj_id, line_id, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS d, CASE WHEN obj_id % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END * ((x - ax) * CASE WHEN line_id IN (0, 3) THEN -1 ELSE 1 END + (y - ay) * CASE WHEN line_id IN (0, 1) THEN -1 ELSE 1 END) AS side FROM m, l),
r AS (SELECT *, row_number() OVER (PARTITION BY pt_idx ORDER BY d, obj_id, line_id) AS n FROM d) SELECT pt_idx, CASE WHEN side < 0 THEN -d ELSE d END AS sdf, obj_id, CAST(line_id AS INTEGER) AS vid FROM r WHERE n = 1""")
def nearest_vertex_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.vertex_distance(marks(spark, sf_dir), "pt_idx", lines(spark, sf_dir), _normals(spark, sf_dir).select("obj_id", "line_id", "nx", "ny"), 1.0)


@query(f"""WITH {_L}, m AS (SELECT r.row, c.col, -7.1::DOUBLE + c.col * 0.37::DOUBLE AS x, -5.1::DOUBLE + r.row * 0.37::DOUBLE AS y FROM (SELECT unnest(range(0, 30)) AS row) r, (SELECT unnest(range(0, 40)) AS col) c),
d AS (SELECT row, col, obj_id, min(sqrt(pow(x - ax - {_SEGT} * (bx - ax), 2) + pow(y - ay - {_SEGT} * (b_y - ay), 2))) AS d, sum({_WIND}) AS w FROM m, l GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d, obj_id) AS n FROM d)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(CASE WHEN (w <> 0) = (obj_id % 3 <> 0) THEN -d ELSE d END, 6) AS sdf FROM n WHERE n = 1""")
def distance_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some objects are the space's walls: their inside is positive."""
    walls = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("obj_id"), (F.col("n_nationkey") % 3 != 0).alias("outside"))
    return surface.distance_image(lines(spark, sf_dir), 30, 40, -7.1, -5.1, 0.37, walls).select("row", "col", r6("sdf"))


@query(f"""WITH {_L}, b AS (SELECT obj_id, line_id, floor(ax * 8) AS x0, floor(ay * 8) AS y0, floor(bx * 8) AS x1, floor(b_y * 8) AS y1 FROM l), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM b), s AS (SELECT *, unnest(range(0, n::BIGINT)) AS step FROM n)
SELECT obj_id, CAST(line_id AS INTEGER) AS line_id, CAST(step AS INTEGER) AS step, CAST(x0 + sign(x1 - x0) * floor((2 * step * abs(x1 - x0) + n - 1) / (2 * n)) AS INTEGER) AS px, CAST(y0 + sign(y1 - y0) * floor((2 * step * abs(y1 - y0) + n - 1) / (2 * n)) AS INTEGER) AS py FROM s""")
def contour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays.polygon_pixels(lines(spark, sf_dir).withColumns({c: F.col(c) * 8 for c in ("ax", "ay", "bx", "by")}))


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 17 AS x0, p_partkey % 11 AS y0, p_partkey * 7 % 41 - 20 AS x1, p_partkey * 5 % 37 - 18 AS y1 FROM part),
n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM b), s AS (SELECT *, unnest(range(0, n + 1)) AS step FROM n),
p AS (SELECT id, CAST(step AS INTEGER) AS step, CAST(x0 + CASE WHEN n = 0 THEN 0 ELSE sign(x1 - x0) * ((2 * step * abs(x1 - x0) + n - 1) // (2 * n)) END AS INTEGER) AS px, CAST(y0 + CASE WHEN n = 0 THEN 0 ELSE sign(y1 - y0) * ((2 * step * abs(y1 - y0) + n - 1) // (2 * n)) END AS INTEGER) AS py FROM s),
h AS (SELECT id, min(step) AS stop FROM p WHERE px < 0 AND py < 0 GROUP BY id) SELECT p.id, step, px, py FROM p LEFT JOIN h ON h.id = p.id WHERE stop IS NULL OR step < stop""")
def pixel_lines_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 17").alias("x0"), F.expr("p_partkey % 11").alias("y0"), F.expr("p_partkey * 7 % 41 - 20").alias("x1"), F.expr("p_partkey * 5 % 37 - 18").alias("y1"))
    return rays.bresenham_until(p, "id", "x0", "y0", "x1", "y1", lambda x, y: (x < 0) & (y < 0)).select("id", "step", "px", "py")


# segments against shapes, poses


@query(f"""WITH {_M}, s AS (SELECT *, (-2 - x) / 3.0::DOUBLE AS ax, (2 - x) / 3.0::DOUBLE AS bx, (-1 - y) / -4.0::DOUBLE AS ay, (1 - y) / -4.0::DOUBLE AS b_y FROM m), n AS (SELECT *, greatest(least(ax, bx), least(ay, b_y), 0) AS a, least(greatest(ax, bx), greatest(ay, b_y), 1) AS b FROM s),
q AS (SELECT *, 9 / 9.0::DOUBLE + 16 / 4.0::DOUBLE AS qa, 2 * (x * 3 / 9 + y * -4 / 4) AS qb, x * x / 9 + y * y / 4 - 1 AS qc FROM n), d AS (SELECT *, CASE WHEN qb * qb - 4 * qa * qc >= 0 THEN sqrt(qb * qb - 4 * qa * qc) END AS root FROM q),
e AS (SELECT *, (-qb - root) / (2 * qa) AS e1, (-qb + root) / (2 * qa) AS e2 FROM d)
SELECT pt_idx, round(CASE WHEN a <= b THEN a END, 6) AS enters, round(CASE WHEN a <= b THEN b END, 6) AS leaves, round(CASE WHEN e1 BETWEEN 0 AND 1 THEN e1 END, 6) AS e1, round(CASE WHEN e2 BETWEEN 0 AND 1 THEN e2 END, 6) AS e2 FROM e""")
def segments_meet_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from (x, y) along (3, -4) through a rectangle and an ellipse."""
    end = [F.col("x") + 3, F.col("y") - 4]
    a, b = G.intersect_rectangle("segment", ["x", "y"], end, [0.0, 0.0], [2.0, 1.0])
    e1, e2 = G.intersect_ellipse("segment", ["x", "y"], end, [0.0, 0.0], [3.0, 2.0])
    return marks(spark, sf_dir).select("pt_idx", r6(a, "enters"), r6(b, "leaves"), r6(e1, "e1"), r6(e2, "e2"))


@query(f"WITH {_M} SELECT pt_idx, round(cos(z / 4), 6) AS c, round(-sin(z / 4), 6) AS s, x AS tx, y AS ty, 0.7::DOUBLE AS tz, round(cos(-0.3::DOUBLE) * (x - 1) - sin(-0.3::DOUBLE) * (y + 2), 6) AS fx, round(sin(-0.3::DOUBLE) * (x - 1) + cos(-0.3::DOUBLE) * (y + 2), 6) AS fy, sqrt(pow(x - 1, 2) + pow(y + 2, 2)) <= 5 AND atan2(sin(-0.3::DOUBLE) * (x - 1) + cos(-0.3::DOUBLE) * (y + 2), cos(-0.3::DOUBLE) * (x - 1) - sin(-0.3::DOUBLE) * (y + 2)) BETWEEN -1.5 AND 2 AS seen FROM m")
def poses_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.path_pose("x", "y", F.col("z") / 4, 0.7)
    f = G.to_frame2(["x", "y"], [1.0, -2.0], 0.3)
    p = marks(spark, sf_dir).withColumns({"ox": F.lit(1.0), "oy": F.lit(-2.0), "ot": F.lit(0.3)})
    seen = sensors.in_frame(["x", "y"], ["ox", "oy", "ot"], F.lit(5.0), -1.5, 2.0)
    return p.select("pt_idx", r6(m[0], "c"), r6(m[1], "s"), m[3].alias("tx"), m[7].alias("ty"), m[11].alias("tz"), r6(f[0], "fx"), r6(f[1], "fy"), seen.alias("seen"))


@query(f"WITH {_RNG} SELECT frame_id, ray_idx, value <> 0 AND value BETWEEN 5 AND 60 AS hit, round(cos(ray_idx * 0.01::DOUBLE) * value, 6) AS local_x, round(frame_id * 0.5 + cos(frame_id * 0.1::DOUBLE) * (cos(ray_idx * 0.01::DOUBLE) * value) - sin(frame_id * 0.1::DOUBLE) * (sin(ray_idx * 0.01::DOUBLE) * value), 6) AS end_x, round(frame_id * -0.25 + sin(frame_id * 0.1::DOUBLE) * (cos(ray_idx * 0.01::DOUBLE) * value) + cos(frame_id * 0.1::DOUBLE) * (sin(ray_idx * 0.01::DOUBLE) * value), 6) AS end_y FROM r")
def frame_end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = spark.range(40).select(F.col("id").alias("frame_id"), (F.col("id") * 0.5).alias("x"), (F.col("id") * -0.25).alias("y"), (F.col("id") * 0.1).alias("theta"))
    return sensors.frame_points(_ranges(spark, sf_dir), poses, 5.0, 60.0).select("frame_id", "ray_idx", "hit", r6("local_x"), r6("end_x"), r6("end_y"))


@query(f"""WITH {_M}, q AS (SELECT s_suppkey AS query, CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125::DOUBLE AS x, CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125::DOUBLE AS y FROM supplier),
d AS (SELECT query, pt_idx, sqrt(pow(q.x - m.x, 2) + pow(q.y - m.y, 2)) AS distance FROM q, m), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, pt_idx) AS n FROM d) SELECT query, pt_idx AS point, distance FROM r WHERE n = 1""")
def closest_end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(_queries(spark, sf_dir), marks(spark, sf_dir), "query", "pt_idx", ["x", "y"], 0.05).select("query", "point", "distance")


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of 24 rays around the origin."""
    a = F.col("ray_idx") * (2 * math.pi / 24) - math.pi
    r = 2 + F.expr("(frame_id * 7 + ray_idx * 5) % 11") / 4
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("ray_idx"))
    return made.select("frame_id", "ray_idx", (r * F.cos(a)).alias("end_x"), (r * F.sin(a)).alias("end_y"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


_STAR = "e AS (SELECT s_suppkey AS frame_id, i AS ray_idx, (2 + (s_suppkey * 7 + i * 5) % 11 / 4.0::DOUBLE) * cos(i * (2 * pi() / 24) - pi()) AS x, (2 + (s_suppkey * 7 + i * 5) % 11 / 4.0::DOUBLE) * sin(i * (2 * pi() / 24) - pi()) AS y FROM supplier, unnest(range(0, 24)) AS u(i)), l AS (SELECT a.frame_id, a.ray_idx, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM e a JOIN e b ON a.frame_id = b.frame_id AND b.ray_idx = (a.ray_idx + 1) % 24)"


@query(f"""WITH {_STAR}, v AS (SELECT DISTINCT frame_id, frame_id % 9 * 0.7::DOUBLE - 2.6::DOUBLE AS x, 0.31::DOUBLE AS y FROM e), w AS (SELECT v.frame_id FROM v JOIN l ON v.frame_id = l.frame_id GROUP BY v.frame_id HAVING sum({_WIND}) <> 0),
c AS (SELECT e.frame_id, e.ray_idx, (e.x - v.x) * (b_y - ay) - (e.y - v.y) * (bx - ax) AS n, (ax - v.x) * (b_y - ay) - (ay - v.y) * (bx - ax) AS s, (ax - v.x) * (e.y - v.y) - (ay - v.y) * (e.x - v.x) AS t FROM e JOIN v ON v.frame_id = e.frame_id JOIN l ON l.frame_id = e.frame_id),
b AS (SELECT DISTINCT frame_id, ray_idx FROM c WHERE n <> 0 AND s / n BETWEEN 1e-9 AND 1 - 1e-9 AND t / n BETWEEN 0 AND 1)
SELECT e.frame_id, CAST(e.ray_idx AS INTEGER) AS ray_idx, round(sqrt(pow(e.x - v.x, 2) + pow(e.y - v.y, 2)), 6) AS range FROM e JOIN v ON v.frame_id = e.frame_id JOIN w ON w.frame_id = e.frame_id ANTI JOIN b ON b.frame_id = e.frame_id AND b.ray_idx = e.ray_idx""")
def ends_seen_from_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _star(spark, sf_dir)
    view = ends.select("frame_id").distinct().select("frame_id", (F.col("frame_id") % 9 * 0.7 - 2.6).alias("px"), F.lit(0.31).alias("py"))
    return sensors.visible_ends(view, ends).select("frame_id", "ray_idx", r6("range"))


@query(f"""WITH {_M}, p AS (SELECT a.frame, a.pt_idx, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM m a JOIN m b ON a.frame = b.frame AND a.pt_idx <> b.pt_idx)
SELECT frame, pt_idx AS ray_idx, CAST(least(11, floor((atan2(dy, dx) + pi()) / (2 * pi() / 12))) AS INTEGER) AS segment, round(max(CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 0 ELSE asin(dz / sqrt(dx * dx + dy * dy + dz * dz)) END), 6) AS elevation FROM p GROUP BY 1, 2, 3""")
def hiding_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir).withColumnRenamed("pt_idx", "ray_idx")
    return sensors.occlusion_sample(m, m, 12, "frame").select("frame", "ray_idx", "segment", r6("elevation"))


@query(f"""WITH {_M}, b AS (SELECT frame, pt_idx, sqrt(x * x + y * y + z * z) AS r, CAST(least(35, floor((atan2(y, x) + pi()) / (2 * pi() / 36))) AS INTEGER) AS row, CAST(floor((asin(z / sqrt(x * x + y * y + z * z)) + 1.2::DOUBLE) / (2.4::DOUBLE / 16)) AS INTEGER) AS col FROM m WHERE x <> 0 OR y <> 0 OR z <> 0)
SELECT frame, row, col, round(arg_min(r, pt_idx), 6) AS range FROM b WHERE col BETWEEN 0 AND 15 GROUP BY 1, 2, 3""")
def cloud_to_range_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = marks(spark, sf_dir).filter("x <> 0 or y <> 0 or z <> 0")
    return sensors.range_image(p, "frame", "pt_idx", 36, 16, -1.2, 1.2).select("frame", "row", "col", r6("range"))


@query(f"WITH {_M}, d AS (SELECT pt_idx, CAST(pt_idx % 64 AS DOUBLE) AS u, CAST(pt_idx % 48 AS DOUBLE) AS v, z / 2 AS d FROM m) SELECT pt_idx, (u - 32) / 20 * d AS x, (v - 24) / 16 * d AS y, d AS z, pt_idx % 256 / 255.0::DOUBLE AS r FROM d WHERE d > 0")
def coloured_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths in half units; those of 0 or less are none."""
    p = marks(spark, sf_dir).select("pt_idx", (F.col("pt_idx") % 64).cast("double").alias("u"), (F.col("pt_idx") % 48).cast("double").alias("v"), F.col("z").alias("depth"), *[(F.col("pt_idx") % 256).alias(c) for c in "rgb"])
    return sensors.rgbd_points(p, 20.0, 16.0, 32.0, 24.0, 2.0).select("pt_idx", "x", "y", "z", "r")


# masks


@query(f"WITH {_M}, {_GRID}, t AS (SELECT abs(row * 7 + col * 3) % 3 AS k FROM g) SELECT sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::BIGINT AS occupied, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS free, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END)::BIGINT AS unknown, count(*) AS cells FROM t")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.abs(F.col("row") * 7 + F.col("col") * 3) % 3
    return gridmap.state_counts(_grid(spark, sf_dir).select(F.when(kind == 0, "free").when(kind == 1, "occupied").otherwise("unknown").alias("state")))


_AROUND = "unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j)"


@query(f"""WITH {_M}, {_GRID}, f AS (SELECT row, col FROM g WHERE (row + col) % 7 <> 0), o AS (SELECT row, col FROM g WHERE (row + col) % 35 = 0), p AS (SELECT row, col FROM g WHERE row BETWEEN -2 AND 2 AND col BETWEEN -2 AND 2),
d AS (SELECT DISTINCT row + i AS row, col + j AS col FROM f, {_AROUND}), c AS (SELECT row + i AS row, col + j AS col FROM d, {_AROUND} GROUP BY 1, 2 HAVING count(*) = 9), n AS (SELECT row + i AS row, col + j AS col FROM c, {_AROUND} GROUP BY 1, 2 HAVING count(*) >= 5),
w AS (SELECT DISTINCT row + i AS row, col + j AS col FROM o, {_AROUND} EXCEPT SELECT row, col FROM p), r AS (SELECT * FROM n UNION SELECT * FROM p EXCEPT SELECT * FROM w)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, 'free' AS mask FROM r UNION ALL SELECT CAST(row AS INTEGER), CAST(col AS INTEGER), 'occupied' FROM w""")
def cleaned_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    free, occupied = gridmap.clean_masks(g.filter("(row + col) % 7 <> 0"), g.filter("(row + col) % 35 = 0"), g.filter("abs(row) <= 2 and abs(col) <= 2"))
    return free.select("row", "col", F.lit("free").alias("mask")).unionByName(occupied.select("row", "col", F.lit("occupied").alias("mask")))


@query(f"""WITH {_L}, m AS (SELECT r.row, c.col, -7.1::DOUBLE + c.col * 0.18::DOUBLE AS x, -5.1::DOUBLE + r.row * 0.18::DOUBLE AS y FROM (SELECT unnest(range(0, 60)) AS row) r, (SELECT unnest(range(0, 80)) AS col) c),
w AS (SELECT row, col, obj_id FROM m, l GROUP BY 1, 2, 3 HAVING sum({_WIND}) <> 0) SELECT DISTINCT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM w""")
def cells_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridmap.frame_mask(lines(spark, sf_dir), 60, 80, -7.1, -5.1, 0.18)


# trees


_NODES = f"""{_PRUNED}, q AS ({_LEAVES}), a AS (SELECT q.d AS leaf, u.d, kx >> (q.d - u.d) AS kx, ky >> (q.d - u.d) AS ky, v FROM q, unnest(range(0, 9)) AS u(d) WHERE u.d <= q.d), n AS (SELECT d, kx, ky, max(v) AS log_odds, max(leaf) = d AS is_leaf FROM a GROUP BY 1, 2, 3)"""
_FIRST = "(SELECT CAST(sum((((kx << (8 - n.d)) >> b & 1)::BIGINT << (2 * b)) + (((ky << (8 - n.d)) >> b & 1)::BIGINT << (2 * b + 1))) AS BIGINT) FROM range(8) AS r(b))"


@query(f"WITH {_NODES}, f AS (SELECT CAST(d AS INTEGER) AS d, {_FIRST} AS first_cell, log_odds, is_leaf FROM n WHERE d <= 6) SELECT d, first_cell, log_odds, is_leaf, row_number() OVER (ORDER BY first_cell, d) - 1 AS place FROM f")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.operators.mesh import numbered

    w = tree.walk(tree.prune(_blocky(spark, sf_dir), T), T, 6).select(F.col("d").cast("int").alias("d"), "first_cell", "log_odds", "is_leaf")
    return numbered(w, "place", ["first_cell", "d"])


@query(f"WITH {_NODES}, {_M}, c AS (SELECT pt_idx, {_K8} FROM m) SELECT pt_idx, CAST(n.d AS INTEGER) AS d, log_odds, is_leaf FROM c JOIN n ON c.kx >> (8 - n.d) = n.kx AND c.ky >> (8 - n.d) = n.ky")
def search_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tree.end_keys(marks(spark, sf_dir), ["x", "y"], T).select("pt_idx", "kx", "ky")
    return tree.search_path(cells, tree.prune(_blocky(spark, sf_dir), T), T).select("pt_idx", F.col("d").cast("int").alias("d"), "log_odds", "is_leaf")


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}) SELECT CAST(d AS INTEGER) AS d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, v AS log_odds FROM q WHERE d >= 2 AND kx >> (d - 2) = 2 AND ky >> (d - 2) = 1")
def leaves_below_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves_below(tree.prune(_blocky(spark, sf_dir), T), [160, 96], 2, T).select("d", "kx", "ky", "log_odds")


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}), c AS (SELECT unnest(range(0, 32)) AS i), n AS (SELECT 6 AS d, i AS kx, 32 AS ky FROM c), f AS (SELECT n.* FROM n ANTI JOIN q ON q.d <= 6 AND n.kx >> (6 - q.d) = q.kx AND n.ky >> (6 - q.d) = q.ky) SELECT CAST(d AS INTEGER) AS d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, 0.0::DOUBLE AS log_odds FROM f")
def inserted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty nodes at depth 6 where no leaf covers them."""
    leaves = tree.prune(_blocky(spark, sf_dir), T)
    cells = spark.range(32).select(F.lit(6).alias("d"), (F.col("id") * 4 + 2).cast("int").alias("kx"), F.lit(130).alias("ky"))
    return tree.insert_node(leaves.filter("d <= 6"), cells, T).filter("log_odds = 0").select("d", "kx", "ky", "log_odds")


@query("WITH p AS (SELECT p_partkey // 16 AS row, p_partkey % 16 AS col, p_partkey * 37 % 101 AS v FROM part), s AS (SELECT max(row) AS h, 15 AS w FROM p), r AS (SELECT i AS row, j AS col FROM s, unnest(range(-2, h + 3)) AS a(i), unnest(range(-2, w + 3)) AS b(j) WHERE i < 0 OR i > h OR j < 0 OR j > w) SELECT CAST(col + 32768 AS INTEGER) AS kx, CAST(row + 32768 AS INTEGER) AS ky, CASE WHEN v >= 50 THEN 0.85::DOUBLE ELSE -0.4::DOUBLE END AS log_odds FROM p UNION ALL SELECT CAST(col + 32768 AS INTEGER), CAST(row + 32768 AS INTEGER), 0.85 FROM r")
def tree_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.plans.queries import S

    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 16").alias("row"), F.expr("p_partkey % 16").alias("col"), F.expr("p_partkey * 37 % 101").alias("value"))
    return tree.image_to_tree(p, S, 50.0, 2).select("kx", "ky", "log_odds")


_SHORT = f"{_M}, r AS (SELECT pt_idx AS ray, frame, x - 0.61::DOUBLE AS sx, y + 0.43::DOUBLE AS sy, x + 0.011::DOUBLE AS ex, y + 0.007::DOUBLE AS ey FROM m)"


@query(f"""WITH RECURSIVE {_SHORT}, {_rays_sql('r')}, u AS (SELECT frame, r.ray, step, kx, ky, -0.4::DOUBLE AS delta FROM cells JOIN r ON r.ray = cells.ray UNION ALL SELECT frame, ray, 1 << 30, {_key('ex', 0.25, 128)}, {_key('ey', 0.25, 128)}, 0.85::DOUBLE FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY kx, ky ORDER BY frame, ray, step) AS n FROM u), f AS (SELECT kx, ky, n, least(3.5, greatest(-2.0, delta)) AS l FROM o WHERE n = 1 UNION ALL SELECT o.kx, o.ky, o.n, least(3.5, greatest(-2.0, f.l + o.delta)) FROM f JOIN o ON o.kx = f.kx AND o.ky = f.ky AND o.n = f.n + 1)
SELECT kx, ky, round(arg_max(l, n), 6) AS log_odds FROM f GROUP BY kx, ky""")
def insert_single_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = marks(spark, sf_dir).select("frame", "pt_idx", (F.col("x") - 0.61).alias("ox"), (F.col("y") + 0.43).alias("oy"), (F.col("x") + 0.011).alias("x"), (F.col("y") + 0.007).alias("y"))
    return tree.insert_rays(p, ["x", "y"], ["ox", "oy"], T).select("kx", "ky", r6("log_odds"))


@query(f"WITH {_M}, k AS (SELECT pt_idx, {_K8} FROM m) SELECT kx, ky, min(pt_idx) AS first, string_agg(CAST(pt_idx AS VARCHAR), ' ' ORDER BY pt_idx) AS rays, (kx - 128 + 0.5::DOUBLE) * 0.25::DOUBLE AS cx, (ky - 128 + 0.5::DOUBLE) * 0.25::DOUBLE AS cy FROM k GROUP BY kx, ky")
def rays_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tree.end_keys(marks(spark, sf_dir), ["x", "y"], T).select("pt_idx", "kx", "ky")
    first = rays.first_ray_of_cell(hits, "pt_idx", ["kx", "ky"]).withColumnRenamed("pt_idx", "first")
    both = first.join(rays.frontier(hits, "pt_idx", ["kx", "ky"]), ["kx", "ky"])
    return rays.cell_coordinates(both.withColumn("rays", F.concat_ws(" ", F.col("rays").cast("array<string>"))), T)


# samples: what holds of any draw


@query(f"WITH {_M} SELECT 'near surface' AS draw, count(*) * 3 AS rows, true AS holds FROM m UNION ALL SELECT 'free cells', NULL, true UNION ALL SELECT 'region', NULL, true UNION ALL SELECT 'occupancy', NULL, true")
def drawn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir)
    near = sensors.sample_near_surface(m.select("pt_idx", "x", "y", F.lit(0.6).alias("vx"), F.lit(0.8).alias("vy"), F.lit(2.0).alias("range")), 3, 0.5, 7)
    at = (F.abs("left") <= 0.5) & (F.abs((F.col("sx") - F.col("x")) * 0.6 + (F.col("sy") - F.col("y")) * 0.8 + F.col("left") - 2) < 1e-9)
    one = near.agg(F.lit("near surface").alias("draw"), F.count(F.lit(1)).alias("rows"), F.min(at).alias("holds"))
    leaves = tree.prune(_blocky(spark, sf_dir).withColumn("log_odds", F.when(F.col("kx") % 2 == 0, -1.0).otherwise(1.0)), T)
    drawn = tree.end_keys(tree.sample_free(leaves, 500, T, 3), ["x", "y"], T)
    two = tree.search(drawn, leaves, T).agg(F.lit("free cells").alias("draw"), F.lit(None).cast("long").alias("rows"), (F.count(F.lit(1)).between(400, 600) & F.max(F.col("log_odds") < 0)).alias("holds"))
    region = sensors.sample_in_region(_star(spark, sf_dir), 4, seed=5)
    three = region.agg(F.lit("region").alias("draw"), F.lit(None).cast("long").alias("rows"), (F.max("view") < 4).alias("holds"))
    infos = gridmap.ray_infos(m.select("pt_idx", "x", "y", (F.col("x") + 3).alias("ex"), (F.col("y") - 2).alias("ey")), [-4.0, -3.0], [4.0, 3.0], 2.0, 10.0)
    four = gridmap.training_set(infos, "pt_idx").agg(F.lit("occupancy").alias("draw"), F.lit(None).cast("long").alias("rows"), F.min(F.col("sx").between(-4 - 1e-9, 4 + 1e-9) & F.col("sy").between(-3 - 1e-9, 3 + 1e-9)).alias("holds"))
    return one.unionByName(two).unionByName(three).unionByName(four)
