"""The spatial queries, as the driver runs them, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.functions import keys as K
from orbweave.operators import gridmap, neighbors, rays, sensors, surface, tree
from orbweave.plans.tables import LINES_SQL, MARKS_SQL, POINTS_SQL, lines, marks, points, table

S = K.TreeSetting(resolution=0.25, depth=16)
#: Smaller trees, for queries over all nodes.
T = K.TreeSetting(resolution=0.25, depth=8)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_P, _M, _L = f"p AS ({POINTS_SQL})", f"m AS ({MARKS_SQL})", f"l AS ({LINES_SQL})"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _key(c: str, res: float = 0.25, off: int = 32768) -> str:
    return f"CAST(floor({c} / {res}::DOUBLE) + {off} AS INTEGER)"


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or str(c))


# flagship: occupied cells of a map built from scans of hits


@query(
    f"""WITH {_P}, k AS (SELECT DISTINCT frame, {_key('x')} AS kx, {_key('y')} AS ky FROM p)
SELECT kx, ky, round(least(3.5::DOUBLE, 0.85::DOUBLE * count(*)), 6) AS log_odds FROM k GROUP BY kx, ky"""
)
def map_from_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tree.end_keys(points(spark, sf_dir), ["x", "y"], S).select("frame", "kx", "ky").distinct()
    built = tree.update_cells(hits.withColumn("delta", F.lit(S.log_odds_hit)), S, ["frame"])
    return built.filter(tree.occupied(S)).select("kx", "ky", r6("log_odds"))


# keys


@query(f"WITH {_P} SELECT kx, ky, kz, count(*) AS n FROM (SELECT {_key('x')} AS kx, {_key('y')} AS ky, {_key('z')} AS kz FROM p) GROUP BY kx, ky, kz")
def keys_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.end_keys(points(spark, sf_dir), ["x", "y", "z"], S).groupBy("kx", "ky", "kz").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT CAST(floor(x / 0.25::DOUBLE) + 16 AS INTEGER) AS k, count(*) AS n FROM p WHERE floor(x / 0.25::DOUBLE) + 16 BETWEEN 0 AND 31 GROUP BY 1")
def keys_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.TreeSetting(resolution=0.25, depth=5)
    return points(spark, sf_dir).select(K.checked_key("x", s).alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_P}, k AS (SELECT DISTINCT {_key('x')} AS kx FROM p), d AS (SELECT kx, unnest([10, 12, 14, 15, 16]) AS d FROM k)
SELECT kx, d, CASE WHEN d = 16 THEN kx ELSE CAST((kx >> (16 - d) << (16 - d)) + (1 << (15 - d)) AS INTEGER) END AS k FROM d"""
)
def keys_at_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = points(spark, sf_dir).select(K.key("x", S).alias("kx")).distinct().select("kx", F.explode(F.array(*map(F.lit, (10, 12, 14, 15, 16)))).alias("d"))
    return k.select("kx", "d", K.at_depth("kx", F.col("d"), S).alias("k"))


@query(
    f"""WITH {_P}, k AS (SELECT DISTINCT {_key('x')} AS kx FROM p), d AS (SELECT kx, unnest([0, 10, 14, 16]) AS d FROM k)
SELECT kx, d, CASE WHEN d = 0 THEN 0::DOUBLE ELSE (floor((kx - 32768) / pow(2, 16 - d)) + 0.5) * 0.25 * pow(2, 16 - d) END AS centre, (kx - 32768) * 0.25::DOUBLE AS vertex, 0.25 * pow(2, 16 - d) AS size FROM d"""
)
def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = points(spark, sf_dir).select(K.key("x", S).alias("kx")).distinct().select("kx", F.explode(F.array(*map(F.lit, (0, 10, 14, 16)))).alias("d"))
    return k.select("kx", "d", K.centre("kx", S, F.col("d")).alias("centre"), K.vertex("kx", S).alias("vertex"), K.node_size(F.col("d"), S).alias("size"))


@query(
    f"""WITH {_P}, k AS (SELECT DISTINCT {_key('x')} AS kx, {_key('y')} AS ky, {_key('z')} AS kz FROM p)
SELECT kx, ky, kz, (SELECT CAST(sum((((kx >> b) & 1)::BIGINT << (2 * b)) + (((ky >> b) & 1)::BIGINT << (2 * b + 1))) AS BIGINT) FROM range(16) AS r(b)) AS code2,
       (SELECT CAST(sum((((kx >> b) & 1)::BIGINT << (3 * b)) + (((ky >> b) & 1)::BIGINT << (3 * b + 1)) + (((kz >> b) & 1)::BIGINT << (3 * b + 2))) AS BIGINT) FROM range(16) AS r(b)) AS code3, kx AS back_x, ky AS back_y, kz AS back_z FROM k"""
)
def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tree.end_keys(points(spark, sf_dir), ["x", "y", "z"], S).select("kx", "ky", "kz").distinct()
    k = k.select("*", K.morton(["kx", "ky"]).alias("code2"), K.morton(["kx", "ky", "kz"]).alias("code3"))
    back = K.unmorton("code3", 3)
    return k.select("*", *[b.alias(f"back_{a}") for a, b in zip("xyz", back, strict=True)])


@query(
    f"""WITH {_P}, k AS (SELECT DISTINCT {_key('x')} AS kx, {_key('y')} AS ky FROM p), x AS (SELECT kx, ky, xor(kx, ky) AS v FROM k)
SELECT kx, ky, CAST(CASE WHEN v = 0 THEN 16 ELSE 16 - length(bin(v)) END AS INTEGER) AS depth, CAST(((kx >> 3) & 1) + 2 * ((ky >> 3) & 1) AS INTEGER) AS child,
       CAST(CASE WHEN v = 0 THEN kx ELSE (kx >> length(bin(v)) << length(bin(v))) + (1 << (length(bin(v)) - 1)) END AS INTEGER) AS above, CASE WHEN kx + 4 < 65536 THEN kx + 4 END AS east, CASE WHEN ky - 1 >= 0 THEN ky - 1 END AS south, CAST(kx AS VARCHAR) || ',' || CAST(ky AS VARCHAR) AS name FROM x"""
)
def key_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tree.end_keys(points(spark, sf_dir), ["x", "y"], S).select("kx", "ky").distinct()
    return k.select("kx", "ky", K.common_ancestor_depth(["kx"], ["ky"], S).alias("depth"), K.common_ancestor(["kx"], ["ky"], S)[0].alias("above"), K.child_index(["kx", "ky"], 3).alias("child"), K.neighbour("kx", 1, 14, S).alias("east"), K.neighbour("ky", -1, 16, S).alias("south"), K.key_text(["kx", "ky"]).alias("name"))


# scalar geometry


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(ln(p / (1 - p)), 6) AS odds, round(1 / (1 + exp(-(l_quantity - 25) / 8)), 6) AS back FROM (SELECT *, (l_quantity + 0.5) / 52 AS p FROM lineitem)")
def log_odds_of_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("p", (F.col("l_quantity") + 0.5) / 52)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", r6(G.log_odds("p"), "odds"), r6(G.probability((F.col("l_quantity") - 25) / 8), "back"))




@query(
    f"""WITH {_M}, t AS (SELECT *, ((x - 1) * 5.5 + (y - 2) * -3.25) / (5.5 * 5.5 + 3.25 * 3.25) AS t FROM m)
SELECT pt_idx, round(sqrt(pow(x - 1 - 5.5 * least(greatest(t, 0), 1), 2) + pow(y - 2 + 3.25 * least(greatest(t, 0), 1), 2)), 6) AS d FROM t"""
)
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select("pt_idx", r6(G.point_segment_distance(["x", "y"], [1.0, 2.0], [6.5, -1.25]), "d"))


@query(
    f"""WITH {_M}, t AS (SELECT pt_idx, x, y, (z * 5 - 1 * y) AS n, ((1 - x) * 5 - (2 - y) * 1) AS a, ((1 - x) * y - (2 - y) * z) AS b FROM m)
SELECT pt_idx, a / n AS s, b / n AS t, coalesce(a / n BETWEEN 0 AND 1 AND b / n BETWEEN 0 AND 1, false) AS hit FROM (SELECT *, CASE WHEN n <> 0 THEN n END AS nn FROM t) WHERE n <> 0
UNION ALL SELECT pt_idx, NULL, NULL, false FROM t WHERE n = 0"""
)
def segments_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from (x, y) along (z, y) against the one from (1, 2) along (1, 5)."""
    end = [F.col("x") + F.col("z"), F.col("y") + F.col("y")]
    s, t = G.line_line(["x", "y"], end, [1.0, 2.0], [2.0, 7.0])
    hit, _, _ = G.intersect2("segment", ["x", "y"], end, "segment", [1.0, 2.0], [2.0, 7.0])
    return marks(spark, sf_dir).select("pt_idx", s.alias("s"), t.alias("t"), hit.alias("hit"))


@query(
    f"""WITH {_M}, n AS (SELECT *, 9 + 4 + 1 AS ee, x * x + y * y + z * z AS dd, 3 * x - 2 * y + z AS de, x * (x - 1) + y * (y - 1) + z * (z + 2) AS dw, 3 * (x - 1) - 2 * (y - 1) + (z + 2) AS ew FROM m),
c AS (SELECT *, dd * ee - de * de AS q FROM n), st AS (SELECT *, (de * ew - ee * dw) / q AS s, (dd * ew - de * dw) / q AS t FROM c WHERE q <> 0)
SELECT pt_idx, round(s, 6) AS s, round(t, 6) AS t, round(sqrt(pow(x - 1 + s * x - t * 3, 2) + pow(y - 1 + s * y + t * 2, 2) + pow(z + 2 + s * z - t, 2)), 6) AS gap FROM st"""
)
def lines_closest_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from (x, y, z) along itself against the one from (1, 1, -2) along (3, -2, 1)."""
    end = [F.col(c) * 2 for c in "xyz"]
    s, t, gap = G.line_line_closest3(["x", "y", "z"], end, [1.0, 1.0, -2.0], [4.0, -1.0, -1.0])
    return marks(spark, sf_dir).select("pt_idx", r6(s, "s"), r6(t, "t"), r6(gap, "gap")).filter("s is not null")


@query(
    f"""WITH {_M}, s AS (SELECT pt_idx, x, y, z, (-2 - x) / 3.0 AS ax, (2 - x) / 3.0 AS bx, (-1 - y) / -4.0 AS ay, (1 - y) / -4.0 AS b_y FROM m),
n AS (SELECT pt_idx, greatest(least(ax, bx), least(ay, b_y)) AS near, least(greatest(ax, bx), greatest(ay, b_y)) AS far FROM s)
SELECT pt_idx, near <= far AS hit, round(near, 6) AS near, round(far, 6) AS far FROM n"""
)
def rays_meet_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, near, far = G.ray_box(["x", "y"], [F.lit(3.0), F.lit(-4.0)], [-2.0, -1.0], [2.0, 1.0])
    return marks(spark, sf_dir).select("pt_idx", hit.alias("hit"), r6(near, "near"), r6(far, "far"))


@query(
    f"""WITH {_M}, q AS (SELECT pt_idx, (3 - x) * (3 - x) / 4 + (z - y) * (z - y) AS a, 2 * (x * (3 - x) / 4 + y * (z - y)) AS b, x * x / 4 + y * y - 1 AS c FROM m),
d AS (SELECT *, b * b - 4 * a * c AS disc FROM q)
SELECT pt_idx, round((-b - sqrt(CASE WHEN disc >= 0 THEN disc END)) / (2 * a), 6) AS t1, round((-b + sqrt(CASE WHEN disc >= 0 THEN disc END)) / (2 * a), 6) AS t2 FROM d WHERE a <> 0"""
)
def lines_meet_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t1, t2 = G.line_ellipsoid(["x", "y"], [F.lit(3.0), F.col("z")], [2.0, 1.0])
    return marks(spark, sf_dir).filter("x <> 3 or y <> z").select("pt_idx", r6(t1, "t1"), r6(t2, "t2"))


@query(
    f"""WITH {_M} SELECT pt_idx, (abs((x - 1) * cos(0.5::DOUBLE) + (y - 1) * sin(0.5::DOUBLE)) <= 3 AND abs(-(x - 1) * sin(0.5::DOUBLE) + (y - 1) * cos(0.5::DOUBLE)) <= 2) AS in_rect,
  (x - 1) * (x - 1) / 9 + (y + 1) * (y + 1) / 4 <= 1 AS in_ellipse, (x BETWEEN -2 AND 2 AND y BETWEEN -1 AND 1 AND z BETWEEN -3 AND 3) AS in_box,
  x * x / 4 + y * y / 9 + z * z / 16 <= 1 AS in_ellipsoid, round(x * cos(0.5::DOUBLE) - y * sin(0.5::DOUBLE), 6) AS turned_x FROM m"""
)
def inside_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p2, p3 = ["x", "y"], ["x", "y", "z"]
    return marks(spark, sf_dir).select(
        "pt_idx",
        G.in_rectangle(p2, [1.0, 1.0], [3.0, 2.0], 0.5).alias("in_rect"),
        G.in_ellipsoid(p2, [1.0, -1.0], [3.0, 2.0]).alias("in_ellipse"),
        G.in_box(p3, [-2.0, -1.0, -3.0], [2.0, 1.0, 3.0]).alias("in_box"),
        G.in_ellipsoid(p3, [0.0, 0.0, 0.0], [2.0, 3.0, 4.0]).alias("in_ellipsoid"),
        r6(G.rotate2(p2, 0.5)[0], "turned_x"),
    )


@query(
    f"""WITH {_M}, b AS (SELECT pt_idx, least(x, y) - 0.5 AS lx, greatest(x, y) + 0.5 AS hx, least(y, z) - 0.5 AS ly, greatest(y, z) + 0.5 AS hy FROM m)
SELECT pt_idx, greatest(lx, -2) AS lx, least(hx, 2) AS hx, greatest(ly, -1) AS ly, least(hy, 1) AS hy, (greatest(lx, -2) <= least(hx, 2) AND greatest(ly, -1) <= least(hy, 1)) AS meets FROM b"""
)
def box_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = G.pad_box([F.least("x", "y"), F.least("y", "z")], [F.greatest("x", "y"), F.greatest("y", "z")], [0.5, 0.5])
    lo, hi = G.box_intersection(low, high, [-2.0, -1.0], [2.0, 1.0])
    return marks(spark, sf_dir).select("pt_idx", lo[0].alias("lx"), hi[0].alias("hx"), lo[1].alias("ly"), hi[1].alias("hy"), G.box_valid(lo, hi).alias("meets"))


@query(
    f"""WITH {_M}, e AS (SELECT pt_idx, x / 4 AS a, y / 4 AS b, z / 4 AS c FROM m)
SELECT pt_idx, round(cos(b) * cos(c), 6) AS m00, round(-cos(b) * sin(c), 6) AS m01, round(sin(b), 6) AS m02, round(cos(a) * sin(c) + sin(a) * sin(b) * cos(c), 6) AS m10,
  round(cos(a) * cos(c) - sin(a) * sin(b) * sin(c), 6) AS m11, round(-sin(a) * cos(b), 6) AS m12 FROM e"""
)
def euler_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.euler_matrix("xyz", [F.col(c) / 4 for c in "xyz"])
    return marks(spark, sf_dir).select("pt_idx", *[r6(m[i][j], f"m{i}{j}") for i in range(2) for j in range(3)])


@query(
    f"""WITH {_M}, c AS (SELECT pt_idx, (x - 0.5) / 2 AS a, (y + 0.25) / 3 AS b, abs(z) + 0.5 AS d FROM m)
SELECT pt_idx, round(a * d, 6) AS px, round(b * d, 6) AS py, round(d * sqrt(a * a + b * b + 1), 6) AS distance, round(d, 6) AS ahead, round(-(a * d), 6) AS lft, round(-(b * d), 6) AS up FROM c"""
)
def camera_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs("z") + 0.5
    ray = G.pixel_direction("x", "y", 2.0, 3.0, 0.5, -0.25)
    at = [r * d for r in ray]
    body = G.optical_to_body(at)
    return marks(spark, sf_dir).select("pt_idx", r6(at[0], "px"), r6(at[1], "py"), r6(G.depth_to_distance(d, "x", "y", 2.0, 3.0, 0.5, -0.25), "distance"), r6(body[0], "ahead"), r6(body[1], "lft"), r6(body[2], "up"))


@query(
    f"""WITH {_M} SELECT pt_idx, round(sqrt(pow((y - 0) * 3 - z * 1, 2) + pow(z * 4 - x * 3, 2) + pow(x * 1 - y * 4, 2)) / 2, 6) AS area FROM m"""
)
def triangle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select("pt_idx", r6(G.triangle_area([0.0, 0.0, 0.0], ["x", "y", "z"], [4.0, 1.0, 3.0]), "area"))


@query(
    f"""WITH {_M}, b AS (SELECT *, (10 * (4 * x + z) + (3 * y - z)) / 169 AS v, (17 * (3 * y - z) + (4 * x + z)) / 169 AS u FROM m), w AS (SELECT *, 1 - v - u AS w FROM b),
s AS (SELECT *, least(greatest((4 * x + z) / 17, 0), 1) AS ab, least(greatest((-4 * (x - 4) + 3 * y - 2 * (z - 1)) / 29, 0), 1) AS bc, least(greatest((-3 * (y - 3) + (z + 1)) / 10, 0), 1) AS ca FROM w)
SELECT pt_idx, round(CASE WHEN w >= 0 AND v >= 0 AND u >= 0 THEN abs(-3 * x + 4 * y + 12 * z) / 13 ELSE sqrt(least(pow(x - 4 * ab, 2) + y * y + pow(z - ab, 2), pow(x - 4 + 4 * bc, 2) + pow(y - 3 * bc, 2) + pow(z - 1 + 2 * bc, 2), x * x + pow(y - 3 + 3 * ca, 2) + pow(z + 1 - ca, 2))) END, 6) AS d,
  round(w, 6) AS w0, round(v, 6) AS w1, round(u, 6) AS w2 FROM s"""
)
def triangle_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.barycentric(["x", "y", "z"], [0.0, 0.0, 0.0], [4.0, 0.0, 1.0], [0.0, 3.0, -1.0])
    return marks(spark, sf_dir).select("pt_idx", r6(G.point_triangle_distance(["x", "y", "z"], [0.0, 0.0, 0.0], [4.0, 0.0, 1.0], [0.0, 3.0, -1.0]), "d"), *[r6(x, f"w{i}") for i, x in enumerate(w)])


# trees


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-depth leaves of the small setting, from hits and misses of events."""
    e = tree.end_keys(marks(spark, sf_dir), ["x", "y"], T).select("pt_idx", "kx", "ky", F.when(F.col("pt_idx") % 3 == 0, F.lit(T.log_odds_miss)).otherwise(F.lit(T.log_odds_hit)).alias("delta"))
    return tree.update_cells(e, T, ["pt_idx"])


_K8 = f"{_key('x', 0.25, 128)} AS kx, {_key('y', 0.25, 128)} AS ky"
_TREE = f"""{_M}, e AS (SELECT pt_idx, {_K8}, CASE WHEN pt_idx % 3 = 0 THEN -0.4::DOUBLE ELSE 0.85::DOUBLE END AS delta FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY kx, ky ORDER BY pt_idx) AS n FROM e),
f AS (SELECT kx, ky, n, least(3.5, greatest(-2.0, delta)) AS l FROM o WHERE n = 1
      UNION ALL SELECT o.kx, o.ky, o.n, least(3.5, greatest(-2.0, f.l + o.delta)) FROM f JOIN o ON o.kx = f.kx AND o.ky = f.ky AND o.n = f.n + 1),
t AS (SELECT kx, ky, round(arg_max(l, n), 6) AS log_odds FROM f GROUP BY kx, ky)"""


@query(f"WITH RECURSIVE {_TREE} SELECT kx, ky, log_odds FROM t")
def ordered_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("kx", "ky", r6("log_odds"))


@query(
    f"""WITH {_M}, k AS (SELECT DISTINCT frame, {_K8} FROM m), c AS (SELECT frame, count(*) AS cells FROM k GROUP BY frame)
SELECT frame, cells FROM c"""
)
def cells_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.points_by_cell(marks(spark, sf_dir), ["x", "y"], T, ["frame"], "pt_idx").groupBy("frame").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {_M}, k AS (SELECT frame, {_K8}, pt_idx FROM m) SELECT frame, kx, ky, string_agg(CAST(pt_idx AS VARCHAR), ' ' ORDER BY pt_idx) AS points FROM k GROUP BY frame, kx, ky")
def points_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.points_by_cell(marks(spark, sf_dir), ["x", "y"], T, ["frame"], "pt_idx").withColumn("points", F.concat_ws(" ", F.col("points").cast("array<string>")))


@query(f"WITH {_M}, k AS (SELECT frame, pt_idx, x, y, z, row_number() OVER (PARTITION BY frame, {_key('x', 0.25, 128)}, {_key('y', 0.25, 128)} ORDER BY pt_idx) AS n FROM m) SELECT frame, pt_idx, x, y, z FROM k WHERE n = 1")
def first_points_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_points(marks(spark, sf_dir), ["x", "y"], T, "frame", "pt_idx")


@query(f"WITH {_M} SELECT pt_idx, round(sqrt(pow(x - 0.5, 2) + pow(y + 0.25, 2)), 6) AS range FROM m WHERE sqrt(pow(x - 0.5, 2) + pow(y + 0.25, 2)) > 1 AND sqrt(pow(x - 0.5, 2) + pow(y + 0.25, 2)) <= 6 AND x BETWEEN -5 AND 5 AND y BETWEEN -4 AND 4")
def gated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = marks(spark, sf_dir).withColumns({"ox": F.lit(0.5), "oy": F.lit(-0.25)})
    return tree.gate(p, ["x", "y"], ["ox", "oy"], 1.0, 6.0, ([-5.0, -4.0], [5.0, 4.0])).select("pt_idx", r6("range"))


#: Crossings of a ray's cells: on each axis, the borders between start and end in order of their time.
def _rays_sql(src: str) -> str:
    return f"""k AS (SELECT *, {_key('sx', 0.25, 128)} AS ax, {_key('sy', 0.25, 128)} AS ay, {_key('ex', 0.25, 128)} AS bx, {_key('ey', 0.25, 128)} AS b_y FROM {src}),
c AS (SELECT ray, 1 AS rank, i, ((ax - 128 + CASE WHEN bx >= ax THEN 1 ELSE 0 END + CASE WHEN bx >= ax THEN i ELSE -i END) * 0.25 - sx) / (ex - sx) AS t FROM k, unnest(range(0, abs(bx - ax))) AS u(i)
      UNION ALL SELECT ray, 0, i, ((ay - 128 + CASE WHEN b_y >= ay THEN 1 ELSE 0 END + CASE WHEN b_y >= ay THEN i ELSE -i END) * 0.25 - sy) / (ey - sy) FROM k, unnest(range(0, abs(b_y - ay))) AS u(i)),
w AS (SELECT ray, row_number() OVER o AS step, sum(rank) OVER o AS nx, sum(1 - rank) OVER o AS ny, count(*) OVER (PARTITION BY ray) AS n FROM c WINDOW o AS (PARTITION BY ray ORDER BY t, rank)),
s AS (SELECT DISTINCT ray, 0 AS step, 0 AS nx, 0 AS ny FROM c UNION ALL SELECT ray, step, nx, ny FROM w WHERE step < n),
cells AS (SELECT k.ray, CAST(step AS INTEGER) AS step, CAST(ax + CASE WHEN bx >= ax THEN nx ELSE -nx END AS INTEGER) AS kx, CAST(ay + CASE WHEN b_y >= ay THEN ny ELSE -ny END AS INTEGER) AS ky FROM s JOIN k ON k.ray = s.ray)"""


_RAYS = f"{_M}, r AS (SELECT pt_idx AS ray, frame, 0.1::DOUBLE AS sx, -0.17::DOUBLE AS sy, x + 0.011 AS ex, y + 0.007 AS ey FROM m)"


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select(F.col("pt_idx").alias("ray"), "frame", F.lit(0.1).alias("sx"), F.lit(-0.17).alias("sy"), (F.col("x") + 0.011).alias("ex"), (F.col("y") + 0.007).alias("ey"))


@query(f"WITH {_RAYS}, {_rays_sql('r')} SELECT ray, step, kx, ky FROM cells")
def ray_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays.ray_cells(_rays(spark, sf_dir).select("ray", "sx", "sy", "ex", "ey"), ["sx", "sy"], ["ex", "ey"], T).select("ray", "step", "kx", "ky")


@query(
    f"""WITH {_RAYS}, {_rays_sql('r')}, h AS (SELECT frame, {_key('ex', 0.25, 128)} AS kx, {_key('ey', 0.25, 128)} AS ky, 1 AS hit FROM r
  UNION ALL SELECT frame, kx, ky, 0 FROM cells JOIN r ON r.ray = cells.ray), u AS (SELECT frame, kx, ky, max(hit) = 1 AS occupied FROM h GROUP BY frame, kx, ky)
SELECT frame, kx, ky, occupied FROM u"""
)
def scan_cell_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rays(spark, sf_dir).select("frame", F.col("ray").alias("pt_idx"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("sx").alias("ox"), F.col("sy").alias("oy"))
    return tree.scan_updates(p, ["x", "y"], ["ox", "oy"], T)


_SCAN = f"""{_RAYS}, {_rays_sql('r')}, h AS (SELECT frame, {_key('ex', 0.25, 128)} AS kx, {_key('ey', 0.25, 128)} AS ky, 1 AS hit FROM r
  UNION ALL SELECT frame, kx, ky, 0 FROM cells JOIN r ON r.ray = cells.ray), u AS (SELECT frame, kx, ky, CASE WHEN max(hit) = 1 THEN 0.85::DOUBLE ELSE -0.4::DOUBLE END AS delta FROM h GROUP BY frame, kx, ky),
o AS (SELECT *, row_number() OVER (PARTITION BY kx, ky ORDER BY frame) AS n FROM u),
f AS (SELECT kx, ky, n, least(3.5, greatest(-2.0, delta)) AS l FROM o WHERE n = 1
      UNION ALL SELECT o.kx, o.ky, o.n, least(3.5, greatest(-2.0, f.l + o.delta)) FROM f JOIN o ON o.kx = f.kx AND o.ky = f.ky AND o.n = f.n + 1),
t AS (SELECT kx, ky, arg_max(l, n) AS log_odds FROM f GROUP BY kx, ky)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rays(spark, sf_dir).select("frame", F.col("ray").alias("pt_idx"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("sx").alias("ox"), F.col("sy").alias("oy"))
    return tree.insert_scans(p, ["x", "y"], ["ox", "oy"], T)


@query(f"WITH RECURSIVE {_SCAN} SELECT kx, ky, round(log_odds, 6) AS log_odds FROM t")
def insert_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("kx", "ky", r6("log_odds"))


@query(f"WITH RECURSIVE {_SCAN}, q AS (SELECT *, CASE WHEN log_odds >= 0 THEN 3.5::DOUBLE ELSE -2.0::DOUBLE END AS ml FROM t) SELECT ml >= 0 AS occupied, count(*) AS cells, sum(ml) AS total FROM q GROUP BY 1")
def most_likely_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tree.most_likely(_scanned(spark, sf_dir), T)
    return m.groupBy(tree.occupied(T).alias("occupied")).agg(F.count(F.lit(1)).alias("cells"), F.sum("log_odds").alias("total"))


@query(
    f"""WITH RECURSIVE {_SCAN}, a AS (SELECT unnest(range(0, 9)) AS d, kx, ky, log_odds FROM t)
SELECT CAST(d AS INTEGER) AS d, CAST(CASE WHEN d = 8 THEN kx ELSE (kx >> (8 - d) << (8 - d)) + (1 << CAST(7 - d AS INTEGER)) END AS INTEGER) AS kx, CAST(CASE WHEN d = 8 THEN ky ELSE (ky >> (8 - d) << (8 - d)) + (1 << CAST(7 - d AS INTEGER)) END AS INTEGER) AS ky,
       round(max(log_odds), 6) AS log_odds, round(ln(avg(1 / (1 + exp(-log_odds))) / (1 - avg(1 / (1 + exp(-log_odds))))), 6) AS mean, count(*) AS leaves FROM a GROUP BY 1, 2, 3"""
)
def inner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(_scanned(spark, sf_dir), T).select("d", "kx", "ky", r6("log_odds"), r6("mean"), "leaves")


def _blocky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with a few values by area, so that siblings are often, and not always, equal."""
    value = 0.25 + F.expr("(kx div 8 + ky div 16) % 3") * 0.5
    return tree.end_keys(points(spark, sf_dir), ["x", "y"], T).select("kx", "ky").distinct().select(F.lit(8).alias("d"), "kx", "ky", value.alias("log_odds"))


_BLOCKY = f"{_P}, b8 AS (SELECT kx, ky, 0.25::DOUBLE + ((kx // 8 + ky // 16) % 3) * 0.5::DOUBLE AS v FROM (SELECT DISTINCT {_K8} FROM p))"
_PRUNED = f"""{_BLOCKY}, """ + ", ".join(
    f"m{d} AS (SELECT kx >> 1 AS kx, ky >> 1 AS ky, min(v) AS v FROM b{d + 1} GROUP BY 1, 2 HAVING count(*) = 4 AND min(v) = max(v)), s{d + 1} AS (SELECT b.kx, b.ky, b.v FROM b{d + 1} b ANTI JOIN m{d} m ON b.kx >> 1 = m.kx AND b.ky >> 1 = m.ky), b{d} AS (SELECT * FROM m{d})" for d in range(7, 0, -1)
)
_LEAVES = " UNION ALL ".join(f"SELECT {d} AS d, kx, ky, v FROM s{d}" for d in range(8, 1, -1)) + " UNION ALL SELECT 1 AS d, kx, ky, v FROM b1"
#: The key of a block at depth d.
_AT = lambda k: f"CAST(CASE WHEN d = 8 THEN {k} ELSE ({k} << (8 - d)) + (1 << (7 - d)) END AS INTEGER)"


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}) SELECT CAST(d AS INTEGER) AS d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, v AS log_odds FROM q")
def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.prune(_blocky(spark, sf_dir), T).select("d", "kx", "ky", "log_odds")


#: Cells of space: those of the plane, as high as their column is long.
_COLUMNS = f"{_P}, b8 AS (SELECT kx, ky, CAST(128 + h AS INTEGER) AS kz, 0.25::DOUBLE + (kx // 16 % 2) * 0.5::DOUBLE AS v FROM (SELECT DISTINCT {_K8} FROM p), unnest(range(0, 4)) AS u(h))"
_OCT = f"{_COLUMNS}, " + ", ".join(
    f"m{d} AS (SELECT kx >> 1 AS kx, ky >> 1 AS ky, kz >> 1 AS kz, min(v) AS v FROM b{d + 1} GROUP BY 1, 2, 3 HAVING count(*) = 8 AND min(v) = max(v)), s{d + 1} AS (SELECT b.* FROM b{d + 1} b ANTI JOIN m{d} m ON b.kx >> 1 = m.kx AND b.ky >> 1 = m.ky AND b.kz >> 1 = m.kz), b{d} AS (SELECT * FROM m{d})" for d in range(7, 3, -1)
)


@query(f"WITH {_OCT}, q AS (" + " UNION ALL ".join(f"SELECT {d} AS d, kx, ky, kz, v FROM s{d}" for d in range(8, 4, -1)) + f" UNION ALL SELECT 4 AS d, kx, ky, kz, v FROM b4) SELECT CAST(d AS INTEGER) AS d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, {_AT('kz')} AS kz, v AS log_odds FROM q")
def pruned_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tree.end_keys(points(spark, sf_dir), ["x", "y"], T).select("kx", "ky").distinct().select("kx", "ky", F.explode(F.array(*map(F.lit, range(128, 132)))).alias("kz"))
    return tree.prune(cells.select(F.lit(8).alias("d"), "kx", "ky", "kz", (0.25 + F.expr("kx div 16 % 2") * 0.5).alias("log_odds")), T, lowest=4)


@query(f"WITH {_BLOCKY} SELECT kx, ky, v AS log_odds FROM b8")
def expanded_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.expand(tree.prune(_blocky(spark, sf_dir), T), T).select("kx", "ky", "log_odds")


@query(
    f"""WITH {_PRUNED}, q AS ({_LEAVES}), {_M}, c AS (SELECT pt_idx, {_K8} FROM m)
SELECT pt_idx, CAST(max(q.d) AS INTEGER) AS d, arg_max(q.v, q.d) AS log_odds FROM c LEFT JOIN q ON c.kx >> (8 - q.d) = q.kx AND c.ky >> (8 - q.d) = q.ky GROUP BY pt_idx"""
)
def search_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tree.end_keys(marks(spark, sf_dir), ["x", "y"], T).select("pt_idx", "kx", "ky")
    return tree.search(cells, tree.prune(_blocky(spark, sf_dir), T), T).select("pt_idx", "d", "log_odds")


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}) SELECT CAST(min(d) AS INTEGER) AS least, count(*) AS leaves, sum(CAST(1 AS BIGINT) << (2 * (8 - d)))::BIGINT AS cells FROM q")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = tree.prune(_blocky(spark, sf_dir), T)
    return leaves.agg(F.min("d").cast("int").alias("least"), F.count(F.lit(1)).alias("leaves"), F.sum(F.pow(F.lit(4.0), F.lit(8) - F.col("d")).cast("long")).alias("cells"))


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}), b AS (SELECT d, ((kx << (8 - d)) - 128) * 0.25::DOUBLE AS lx, ((kx << (8 - d)) - 128 + (1 << (8 - d))) * 0.25::DOUBLE AS hx, ((ky << (8 - d)) - 128) * 0.25::DOUBLE AS ly, ((ky << (8 - d)) - 128 + (1 << (8 - d))) * 0.25::DOUBLE AS hy FROM q) SELECT min(lx) AS min_x, max(hx) AS max_x, min(ly) AS min_y, max(hy) AS max_y FROM b")
def tree_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.bounds(tree.prune(_blocky(spark, sf_dir), T), T)


@query(
    f"""WITH {_PRUNED}, q AS ({_LEAVES}), b AS (SELECT d, kx, ky, ((kx << (8 - d)) - 128) * 0.25::DOUBLE AS lx, ((kx << (8 - d)) - 128 + (1 << (8 - d))) * 0.25::DOUBLE AS hx, ((ky << (8 - d)) - 128) * 0.25::DOUBLE AS ly, ((ky << (8 - d)) - 128 + (1 << (8 - d))) * 0.25::DOUBLE AS hy FROM q)
SELECT CAST(d AS INTEGER) AS d, lx AS min_x, hx AS max_x, ly AS min_y, hy AS max_y FROM b WHERE lx < 2.6 AND hx > -3.1 AND ly < 1.9 AND hy > -2.2"""
)
def leaves_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.leaves_in_box(tree.prune(_blocky(spark, sf_dir), T), [-3.1, -2.2], [2.6, 1.9], T)
    return tree.leaf_boxes(found, T).select("d", "min_x", "max_x", "min_y", "max_y")


@query(
    f"""WITH {_PRUNED}, q AS ({_LEAVES}), b AS (SELECT d, (kx << (8 - d)) AS lx, ((kx + 1) << (8 - d)) AS hx, (ky << (8 - d)) AS ly, ((ky + 1) << (8 - d)) AS hy FROM q)
SELECT CAST(a.d AS INTEGER) AS a_d, CAST(b.d AS INTEGER) AS b_d, count(*) AS n FROM b a JOIN b ON a.hx = b.lx AND a.ly < b.hy AND b.ly < a.hy GROUP BY 1, 2"""
)
def leaf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaf_neighbours(tree.prune(_blocky(spark, sf_dir), T), T, 0, 1).groupBy("a_d", "b_d").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT kx, ky, log_odds >= 0 AS was FROM t WHERE (kx + ky) % 2 = 0), n AS (SELECT kx, ky, log_odds - 0.6 >= 0 AS now FROM t) SELECT n.kx, n.ky, was IS NULL AS is_new FROM n LEFT JOIN w ON n.kx = w.kx AND n.ky = w.ky WHERE was IS NULL OR was <> now")
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir).withColumn("log_odds", F.round("log_odds", 6))
    return tree.changes(t.filter("(kx + ky) % 2 = 0"), t.withColumn("log_odds", F.col("log_odds") - 0.6), T)


@query(f"WITH RECURSIVE {_TREE} SELECT kx, ky FROM t WHERE NOT (kx >> 3 = 16 AND ky >> 3 = 16)")
def deleted_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.delete_block(_tree(spark, sf_dir), [130, 130], 5, T).select("kx", "ky")


# rays against trees


@query(
    f"""WITH RECURSIVE {_TREE}, r AS (SELECT s_suppkey AS ray, 0.03::DOUBLE AS sx, 0.02::DOUBLE AS sy, 0.03 + cos(s_suppkey * 0.37::DOUBLE) * 6.5 AS ex, 0.02 + sin(s_suppkey * 0.37::DOUBLE) * 6.5 AS ey FROM supplier WHERE s_suppkey > 0),
k AS (SELECT *, {_key('sx', 0.25, 128)} AS ax, {_key('sy', 0.25, 128)} AS ay, {_key('ex', 0.25, 128)} AS bx, {_key('ey', 0.25, 128)} AS b_y FROM r),
c AS (SELECT ray, 1 AS rank, ((ax - 128 + CASE WHEN bx >= ax THEN 1 ELSE 0 END + CASE WHEN bx >= ax THEN i ELSE -i END) * 0.25 - sx) / (ex - sx) AS t FROM k, unnest(range(0, abs(bx - ax))) AS u(i)
      UNION ALL SELECT ray, 0, ((ay - 128 + CASE WHEN b_y >= ay THEN 1 ELSE 0 END + CASE WHEN b_y >= ay THEN i ELSE -i END) * 0.25 - sy) / (ey - sy) FROM k, unnest(range(0, abs(b_y - ay))) AS u(i)),
w AS (SELECT ray, row_number() OVER o AS step, sum(rank) OVER o AS nx, sum(1 - rank) OVER o AS ny FROM c WINDOW o AS (PARTITION BY ray ORDER BY t, rank)),
z AS (SELECT ray, 0 AS step, 0 AS nx, 0 AS ny FROM r UNION ALL SELECT * FROM w),
cells AS (SELECT k.ray, step, CAST(ax + CASE WHEN bx >= ax THEN nx ELSE -nx END AS INTEGER) AS kx, CAST(ay + CASE WHEN b_y >= ay THEN ny ELSE -ny END AS INTEGER) AS ky, sx, sy FROM z JOIN k ON k.ray = z.ray),
g AS (SELECT ray, step, cells.kx, cells.ky, sqrt(pow((cells.kx - 127.5) * 0.25 - sx, 2) + pow((cells.ky - 127.5) * 0.25 - sy, 2)) AS distance FROM cells JOIN t ON t.kx = cells.kx AND t.ky = cells.ky AND t.log_odds >= 0),
h AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY step) AS n FROM g WHERE distance <= 6 OR step = 0)
SELECT ray, CAST(step AS INTEGER) AS step, kx, ky, round(distance, 6) AS distance FROM h WHERE n = 1"""
)
def cast_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("ray"), F.lit(0.03).alias("sx"), F.lit(0.02).alias("sy"), F.cos(F.col("s_suppkey") * 0.37).alias("vx"), F.sin(F.col("s_suppkey") * 0.37).alias("vy"))
    return rays.cast_rays(r, "ray", _tree(spark, sf_dir), T, ["sx", "sy"], ["vx", "vy"], 6.0).select("ray", "step", "kx", "ky", r6("distance"))


@query(
    f"""WITH {_PRUNED}, q AS ({_LEAVES}), g AS (SELECT d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, v AS log_odds, ((kx << (8 - d)) - 128) * 0.25::DOUBLE AS lx, ((ky << (8 - d)) - 128) * 0.25::DOUBLE AS ly, (1 << (8 - d)) * 0.25::DOUBLE AS w FROM q),
r AS (SELECT s_suppkey AS ray, cos(s_suppkey * 0.37::DOUBLE) AS vx, sin(s_suppkey * 0.37::DOUBLE) AS vy FROM supplier),
t AS (SELECT *, (lx - 0.03::DOUBLE) / vx AS ax, (lx + w - 0.03::DOUBLE) / vx AS bx, CASE WHEN vy = 0 THEN '-inf'::DOUBLE ELSE (ly - 0.02::DOUBLE) / vy END AS ay, CASE WHEN vy = 0 THEN 'inf'::DOUBLE ELSE (ly + w - 0.02::DOUBLE) / vy END AS b_y FROM r, g WHERE vy <> 0 OR 0.02 BETWEEN ly AND ly + w),
h AS (SELECT *, greatest(least(ax, bx), least(ay, b_y)) AS near, least(greatest(ax, bx), greatest(ay, b_y)) AS far FROM t)
SELECT ray, CAST(d AS INTEGER) AS d, kx, ky, log_odds, round(near, 6) AS near, round(far, 6) AS far, CAST(row_number() OVER (PARTITION BY ray ORDER BY abs(near), d, kx, ky) AS INTEGER) AS rank FROM h WHERE near <= far AND far >= 0 AND abs(near) <= 6"""
)
def nodes_on_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ray"), F.lit(0.03).alias("sx"), F.lit(0.02).alias("sy"), F.cos(F.col("s_suppkey") * 0.37).alias("vx"), F.sin(F.col("s_suppkey") * 0.37).alias("vy"))
    return rays.nodes_on_rays(r, "ray", tree.prune(_blocky(spark, sf_dir), T), T, ["sx", "sy"], ["vx", "vy"], 6.0, coarse=4).withColumns({"near": F.round("near", 6), "far": F.round("far", 6)})


@query(
    """WITH b AS (SELECT p_partkey AS id, p_partkey % 17 AS x0, p_partkey % 11 AS y0, p_partkey * 7 % 41 - 20 AS x1, p_partkey * 5 % 37 - 18 AS y1 FROM part),
n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM b), s AS (SELECT *, unnest(range(0, n + 1)) AS step FROM n)
SELECT id, CAST(step AS INTEGER) AS step, CAST(x0 + CASE WHEN n = 0 THEN 0 ELSE sign(x1 - x0) * ((2 * step * abs(x1 - x0) + n - 1) // (2 * n)) END AS INTEGER) AS px,
       CAST(y0 + CASE WHEN n = 0 THEN 0 ELSE sign(y1 - y0) * ((2 * step * abs(y1 - y0) + n - 1) // (2 * n)) END AS INTEGER) AS py FROM s"""
)
def pixel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 17").alias("x0"), F.expr("p_partkey % 11").alias("y0"), F.expr("p_partkey * 7 % 41 - 20").alias("x1"), F.expr("p_partkey * 5 % 37 - 18").alias("y1"))
    return rays.bresenham(p, "x0", "y0", "x1", "y1").select("id", "step", "px", "py")


@query(
    f"""WITH RECURSIVE {_M}, s AS (SELECT pt_idx, x, y, CASE WHEN sqrt(x * x + y * y) < 1 THEN -1 ELSE 1 END AS side, 0 AS i, 0::DOUBLE AS t FROM m
      UNION ALL SELECT pt_idx, x, y, side, i + 1, CASE WHEN t > 30 THEN t ELSE t + side * (sqrt((x + t) * (x + t) + y * y) - 1) END FROM s WHERE i < 64)
SELECT pt_idx, round(t, 3) AS t, t <= 30 AND abs(sqrt((x + t) * (x + t) + y * y) - 1) <= 1e-5 AS hit FROM s WHERE i = 64"""
)
def sphere_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: hits, misses, rays that look away, graze or start inside."""
    p = marks(spark, sf_dir).withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0)})
    t = rays.sphere_trace(p, ["x", "y"], ["vx", "vy"], lambda q: F.sqrt(q[0] * q[0] + q[1] * q[1]) - 1.0, 30.0)
    return t.select("pt_idx", F.round("t", 3).alias("t"), "hit")


# joins


@query(
    f"""WITH {_M}, q AS (SELECT s_suppkey AS query, CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125::DOUBLE AS x, CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125::DOUBLE AS y FROM supplier)
SELECT query, pt_idx AS point, round(sqrt(pow(q.x - m.x, 2) + pow(q.y - m.y, 2)), 6) AS distance FROM q, m WHERE sqrt(pow(q.x - m.x, 2) + pow(q.y - m.y, 2)) <= 0.75"""
)
def points_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.radius_join(_queries(spark, sf_dir), marks(spark, sf_dir), "query", "pt_idx", ["x", "y"], 0.75).select("query", "point", r6("distance"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), F.expr("CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125D").alias("x"), F.expr("CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125D").alias("y"))


@query(
    f"""WITH {_M}, q AS (SELECT s_suppkey AS query, CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125::DOUBLE AS x, CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125::DOUBLE AS y FROM supplier),
d AS (SELECT query, pt_idx, sqrt(pow(q.x - m.x, 2) + pow(q.y - m.y, 2)) AS distance FROM q, m), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, pt_idx) AS rank FROM d)
SELECT query, pt_idx AS point, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.knn_join(_queries(spark, sf_dir), marks(spark, sf_dir), "query", "pt_idx", ["x", "y"], 5, 0.5).select("query", "point", r6("distance"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query, vec_id AS point, list_distance(a, embedding::DOUBLE[]) AS distance FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), point) AS rank FROM d) SELECT query, point, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return neighbors.vector_knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", 8).select("query", "point", r6("distance"), "rank")


# surfaces


_WIND = "CASE WHEN ay <= y AND b_y > y AND (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) > 0 THEN 1 WHEN ay > y AND b_y <= y AND (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) < 0 THEN -1 ELSE 0 END"
_SEGT = "least(greatest(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)), 0), 1)"


@query(f"WITH {_M}, {_L}, w AS (SELECT pt_idx, obj_id, sum({_WIND}) AS w FROM m, l GROUP BY 1, 2) SELECT pt_idx, obj_id FROM w WHERE w <> 0")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.points_in_polygons(marks(spark, sf_dir), "pt_idx", lines(spark, sf_dir))


@query(
    f"""WITH {_M}, {_L}, d AS (SELECT pt_idx, obj_id, line_id, sqrt(pow(x - ax - {_SEGT} * (bx - ax), 2) + pow(y - ay - {_SEGT} * (b_y - ay), 2)) AS d, {_WIND} AS w FROM m, l),
b AS (SELECT pt_idx, obj_id, min(d) AS d, sum(w) AS w FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pt_idx ORDER BY d, obj_id) AS n FROM b)
SELECT pt_idx, round(CASE WHEN w <> 0 THEN -d ELSE d END, 6) AS sdf FROM r WHERE n = 1"""
)
def signed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.signed_distance(marks(spark, sf_dir), "pt_idx", lines(spark, sf_dir)).select("pt_idx", r6("sdf"))


_HIT = """h AS (SELECT pt_idx, (0.6 * (ay - b_y) - 0.8 * (ax - bx)) AS n, (x - bx) * 0.8 - (y - b_y) * 0.6 AS a, (ax - bx) * (y - b_y) - (ay - b_y) * (x - bx) AS b FROM m, l),
g AS (SELECT pt_idx, CASE WHEN n <> 0 AND -a / n BETWEEN 0 AND 1 THEN b / n END AS t FROM h)"""


@query(f"WITH {_M}, {_L}, {_HIT} SELECT pt_idx, round(coalesce(min(CASE WHEN t >= 0 THEN t END), 1e9), 6) AS ahead FROM g GROUP BY pt_idx")
def distances_along_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = marks(spark, sf_dir).withColumns({"vx": F.lit(0.6), "vy": F.lit(0.8)})
    d = surface.directional_distance(r, "pt_idx", lines(spark, sf_dir))
    return d.select("pt_idx", r6(F.when(F.col("distance") == float("inf"), 1e9).otherwise(F.col("distance")), "ahead"))


@query(f"WITH {_M}, {_L}, {_HIT} SELECT pt_idx, round(coalesce(min(t), 1e9), 6) AS first FROM g GROUP BY pt_idx")
def signed_distances_along_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = marks(spark, sf_dir).withColumns({"vx": F.lit(0.6), "vy": F.lit(0.8)})
    d = surface.signed_directional_distance(r, "pt_idx", lines(spark, sf_dir))
    return d.select("pt_idx", r6(F.when(F.col("distance") == float("inf"), 1e9).otherwise(F.col("distance")), "first"))


@query(
    f"""WITH {_M}, {_L}, {_HIT}, d AS (SELECT pt_idx, obj_id, line_id, sqrt(pow(x - ax - {_SEGT} * (bx - ax), 2) + pow(y - ay - {_SEGT} * (b_y - ay), 2)) AS d, {_WIND} AS w FROM m, l),
b AS (SELECT pt_idx, obj_id, min(d) AS d, sum(w) AS w FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pt_idx ORDER BY d, obj_id) AS n FROM b), i AS (SELECT pt_idx, w <> 0 AND d > 0 AS inside FROM r WHERE n = 1),
e AS (SELECT pt_idx, min(CASE WHEN t >= 0 THEN t END) AS ahead, max(CASE WHEN t <= 0 THEN t END) AS behind FROM g GROUP BY pt_idx)
SELECT e.pt_idx, round(CASE WHEN inside THEN coalesce(behind, -1e9) ELSE coalesce(ahead, 1e9) END, 6) AS distance FROM e JOIN i ON e.pt_idx = i.pt_idx"""
)
def inside_distances_along_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = marks(spark, sf_dir).withColumns({"vx": F.lit(0.6), "vy": F.lit(0.8)})
    d = surface.signed_directional_distance_inside(r, "pt_idx", lines(spark, sf_dir))
    return d.select("pt_idx", r6(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.col("distance"))), "distance"))


@query(
    f"""WITH {_L}, a AS (SELECT s_suppkey AS frame_id, i AS ray_idx, CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125::DOUBLE AS x, CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125::DOUBLE AS y, s_suppkey * 0.1::DOUBLE AS theta, -pi() + 2 * pi() * i / 36 AS angle FROM supplier, unnest(range(0, 36)) AS u(i)),
r AS (SELECT *, cos(theta + angle) AS vx, sin(theta + angle) AS vy FROM a), h AS (SELECT frame_id, ray_idx, angle, vx * (ay - b_y) - vy * (ax - bx) AS n, -((x - bx) * vy - (y - b_y) * vx) AS w, (ax - bx) * (y - b_y) - (ay - b_y) * (x - bx) AS t FROM r, l)
SELECT frame_id, CAST(ray_idx AS INTEGER) AS ray_idx, round(angle, 6) AS angle, round(coalesce(min(CASE WHEN n <> 0 AND w / n BETWEEN 0 AND 1 AND t / n >= 0 THEN t / n END), 1e9), 6) AS range FROM h GROUP BY frame_id, ray_idx, angle"""
)
def lidar_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.expr("CAST(s_suppkey * 7 % 601 - 300 AS DOUBLE) * 0.03125D").alias("x"), F.expr("CAST(s_suppkey * 13 % 401 - 200 AS DOUBLE) * 0.03125D").alias("y"), (F.col("s_suppkey") * 0.1).alias("theta"))
    return sensors.lidar_scan(poses, lines(spark, sf_dir), sensors.scan_angles(-3.141592653589793, 3.141592653589793, 36)).select("frame_id", "ray_idx", r6("angle"), r6(F.least(F.lit(1e9), F.col("range")), "range"))


@query(
    f"""WITH {_L}, m AS (SELECT r.row, c.col, -7.1::DOUBLE + c.col * 0.18::DOUBLE AS x, -5.1::DOUBLE + r.row * 0.18::DOUBLE AS y FROM (SELECT unnest(range(0, 60)) AS row) r, (SELECT unnest(range(0, 80)) AS col) c),
w AS (SELECT row, col, obj_id FROM m, l GROUP BY 1, 2, 3 HAVING sum({_WIND}) <> 0), h AS (SELECT row, col, max(obj_id) AS obj_id FROM w GROUP BY 1, 2)
SELECT CAST(m.row AS INTEGER) AS row, CAST(m.col AS INTEGER) AS col, CASE WHEN obj_id % 3 <> 0 THEN 255 ELSE 0 END AS value FROM m LEFT JOIN h ON m.row = h.row AND m.col = h.col"""
)
def raster_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("obj_id"), (F.col("n_nationkey") % 3 == 0).alias("outside"))
    return surface.rasterise(lines(spark, sf_dir), holes, 60, 80, -7.1, -5.1, 0.18)


# sensors


_RNG = "r AS (SELECT user_id % 40 AS frame_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS ray_idx, value FROM events)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.expr("user_id % 40").alias("frame_id"), "event_id", "value")
    return e.withColumn("ray_idx", F.row_number().over(Window.partitionBy("frame_id").orderBy("event_id")) - 1).select("frame_id", "ray_idx", (F.col("ray_idx") * 0.01).alias("angle"), F.col("value").alias("range"))


@query(f"WITH {_RNG} SELECT frame_id, count(*) AS rays, sum(CASE WHEN value <> 0 AND value BETWEEN 5 AND 60 THEN 1 ELSE 0 END)::BIGINT AS hits, max(CASE WHEN value <> 0 AND value BETWEEN 5 AND 60 THEN value END) AS reach FROM r GROUP BY frame_id")
def frame_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = sensors.hit_mask("range", 5.0, 60.0)
    return _ranges(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("rays"), F.sum(hit.cast("long")).alias("hits"), F.max(F.when(hit, F.col("range"))).alias("reach"))


@query(
    f"""WITH {_RNG}, h AS (SELECT *, value <> 0 AND value BETWEEN 5 AND 60 AS hit FROM r), n AS (SELECT *, coalesce(lag(NOT hit) OVER (PARTITION BY frame_id ORDER BY ray_idx), true) AS new FROM h),
p AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY frame_id ORDER BY ray_idx) AS part FROM n), g AS (SELECT frame_id, part, min(ray_idx) AS first, max(ray_idx) AS last, count(*) AS size FROM p WHERE hit GROUP BY 1, 2)
SELECT frame_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, size FROM g WHERE size >= 3"""
)
def ray_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir).withColumn("broken", F.lit(False))
    return sensors.partition_rays(r, 5.0, 60.0, 3).select("frame_id", "first", "last", "size")


@query(
    f"""WITH RECURSIVE {_RNG}, s AS (SELECT frame_id, ray_idx, value, abs((lead(value) OVER o - value) / ((ray_idx + 1) * 0.01::DOUBLE - ray_idx * 0.01::DOUBLE)) AS slope FROM r WINDOW o AS (PARTITION BY frame_id ORDER BY ray_idx)),
a AS (SELECT frame_id, ray_idx, slope AS was, slope, 0.9::DOUBLE * slope + (1 - 0.9::DOUBLE) * slope AS mean FROM s WHERE ray_idx = 0
      UNION ALL SELECT s.frame_id, s.ray_idx, a.mean, s.slope, 0.9::DOUBLE * a.mean + (1 - 0.9::DOUBLE) * s.slope FROM a JOIN s ON s.frame_id = a.frame_id AND s.ray_idx = a.ray_idx + 1)
SELECT a.frame_id, a.ray_idx, value AS range, coalesce(a.slope > 10 * was, true) AS broken FROM a JOIN s ON s.frame_id = a.frame_id AND s.ray_idx = a.ray_idx"""
)
def ray_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.mark_breaks(_ranges(spark, sf_dir), 5.0, 60.0).select("frame_id", "ray_idx", "range", "broken")


@query(
    f"""WITH {_M}, b AS (SELECT frame, pt_idx, sqrt(x * x + y * y) AS r, CAST(floor((atan2(y, x) + pi()) / (2 * pi() / 90)) AS INTEGER) AS ray_idx FROM m), f AS (SELECT frame, ray_idx, arg_min(r, pt_idx) AS range FROM b WHERE ray_idx BETWEEN 0 AND 89 GROUP BY 1, 2),
e AS (SELECT frame, CAST(i AS INTEGER) AS ray_idx FROM (SELECT DISTINCT frame FROM m), unnest(range(0, 90)) AS u(i)) SELECT e.frame, e.ray_idx, round(coalesce(range, -1), 6) AS range FROM e LEFT JOIN f ON e.frame = f.frame AND e.ray_idx = f.ray_idx"""
)
def cloud_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    return sensors.bin_ranges(marks(spark, sf_dir), "frame", "pt_idx", -math.pi, math.pi, 90).select("frame", "ray_idx", r6("range"))


@query(
    f"""WITH {_M}, b AS (SELECT frame, pt_idx, z, CAST(floor(y / z * 20 + 24) AS INTEGER) AS row, CAST(floor(x / z * 20 + 32) AS INTEGER) AS col FROM m WHERE z > 0)
SELECT frame, row, col, arg_min(z, pt_idx) AS depth FROM b WHERE row BETWEEN 0 AND 47 AND col BETWEEN 0 AND 63 GROUP BY 1, 2, 3"""
)
def cloud_to_depth_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.depth_image(marks(spark, sf_dir), "frame", "pt_idx", 20.0, 20.0, 32.0, 24.0, 64, 48)


@query(f"WITH {_M}, s AS (SELECT pt_idx, x, y, sqrt(x * x + y * y) AS range, unnest(range(0, 5)) AS sample FROM m) SELECT pt_idx, CAST(sample AS INTEGER) AS sample, x + 0.6::DOUBLE * (sample * ((range + 0.5::DOUBLE) / 4)) AS sx, range - sample * ((range + 0.5::DOUBLE) / 4) AS lft FROM s")
def samples_along_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = marks(spark, sf_dir).select("pt_idx", "x", "y", F.lit(0.6).alias("vx"), F.lit(0.8).alias("vy"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("range"))
    return sensors.sample_along(r, n=5, behind=0.5).select("pt_idx", "sample", "sx", F.col("left").alias("lft"))


# grid maps


_GRID = f"g AS (SELECT DISTINCT {_key('y', 0.5, 0)} AS row, {_key('x', 0.5, 0)} AS col FROM m)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select(F.floor(F.col("y") / 0.5).cast("int").alias("row"), F.floor(F.col("x") / 0.5).cast("int").alias("col")).distinct()


@query(f"WITH {_M}, {_GRID} SELECT DISTINCT CAST(row + i AS INTEGER) AS row, CAST(col + j AS INTEGER) AS col FROM g, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j)")
def dilated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridmap.dilate(_grid(spark, sf_dir))


@query(f"WITH {_M}, {_GRID}, n AS (SELECT row + i AS row, col + j AS col, count(*) AS n FROM g, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j) GROUP BY 1, 2) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, n = 9 AS eroded FROM n WHERE n >= 5")
def eroded_and_median_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    return gridmap.median3(g).join(gridmap.erode(g).withColumn("e", F.lit(True)), ["row", "col"], "left").select("row", "col", F.coalesce("e", F.lit(False)).alias("eroded"))


@query(
    f"""WITH RECURSIVE {_M}, u AS (SELECT pt_idx AS frame, {_key('y', 0.5, 0)} AS row, {_key('x', 0.5, 0)} AS col, CASE WHEN pt_idx % 4 = 0 THEN 0.9::DOUBLE ELSE -0.5::DOUBLE END AS delta FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY frame) AS n FROM u), v AS (SELECT row, col, n, least(3.5, greatest(-2.0, delta)) AS l FROM o WHERE n = 1 UNION ALL SELECT o.row, o.col, o.n, least(3.5, greatest(-2.0, v.l + o.delta)) FROM v JOIN o ON o.row = v.row AND o.col = v.col AND o.n = v.n + 1),
s AS (SELECT *, CASE WHEN l >= 0.5 THEN 'occupied' WHEN l <= -0.8 THEN 'free' END AS mark FROM v)
SELECT row, col, round(arg_max(l, n), 6) AS log_odds, coalesce(arg_max(mark, n), 'unknown') AS state FROM s GROUP BY row, col"""
)
def hysteresis_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = marks(spark, sf_dir).select(F.col("pt_idx").alias("frame"), F.floor(F.col("y") / 0.5).cast("int").alias("row"), F.floor(F.col("x") / 0.5).cast("int").alias("col"), F.when(F.col("pt_idx") % 4 == 0, 0.9).otherwise(-0.5).alias("delta"))
    return gridmap.update_map(u, T, -0.8, 0.5).select("row", "col", r6("log_odds"), "state")


@query(f"WITH {_M}, {_GRID}, s AS (SELECT DISTINCT row, col FROM g WHERE (row + col) % 3 = 0) SELECT count(*) AS free, sum(CASE WHEN s.row IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS scanned, round(sum(CASE WHEN s.row IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS ratio, sum(CASE WHEN s.row IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE >= 0.97 AS verified FROM g LEFT JOIN s ON g.row = s.row AND g.col = s.col")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    return gridmap.verified(gridmap.coverage(g, g.filter("(row + col) % 3 = 0"))).select("free", F.col("scanned").cast("long").alias("scanned"), r6("ratio"), "verified")


@query(
    f"""WITH {_M}, {_GRID}, t AS (SELECT row, col, CASE abs(row * 7 + col * 3) % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'occupied' ELSE 'unknown' END AS state FROM g), h AS (SELECT DISTINCT row + i AS row, col + j AS col FROM t, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j) WHERE state = 'unknown' UNION SELECT row, col FROM t WHERE state = 'occupied')
SELECT t.row, t.col FROM t LEFT JOIN h ON t.row = h.row AND t.col = h.col WHERE abs(1 - CASE WHEN h.row IS NULL THEN 0 ELSE 1 END - CASE WHEN state = 'free' THEN 1 ELSE 0 END) = 1"""
)
def frontier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.abs(F.col("row") * 7 + F.col("col") * 3) % 3
    g = _grid(spark, sf_dir)
    return gridmap.frontiers(g.filter(kind == 0), g.filter(kind == 1), g.filter(kind == 2))


@query(f"WITH {_M}, v AS (SELECT pt_idx, pt_idx % 102 - 1 AS value FROM m) SELECT pt_idx, round(CASE WHEN value BETWEEN 1 AND 99 THEN ln(value / 100.0::DOUBLE / (1 - value / 100.0::DOUBLE)) END, 6) AS log_odds, value = 0 OR value = 100 AS sure FROM v")
def possibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = gridmap.possibility_map(marks(spark, sf_dir).select("pt_idx", F.expr("pt_idx % 102 - 1").alias("value")))
    infinite = F.abs("log_odds") == float("inf")
    return v.select("pt_idx", r6(F.when(~infinite, F.col("log_odds")), "log_odds"), F.coalesce(infinite, F.lit(False)).alias("sure"))


@query(
    f"""WITH {_M}, r AS (SELECT pt_idx, x, y, x + 3 AS ex, y - 2 AS ey FROM m), s AS (SELECT *, greatest(least((-4 - x) / 3.0::DOUBLE, (4 - x) / 3.0::DOUBLE), least((-3 - y) / -2.0::DOUBLE, (3 - y) / -2.0::DOUBLE), 0) AS r1, least(greatest((-4 - x) / 3.0::DOUBLE, (4 - x) / 3.0::DOUBLE), greatest((-3 - y) / -2.0::DOUBLE, (3 - y) / -2.0::DOUBLE), 1) AS r2 FROM r)
SELECT pt_idx, round(r1, 6) AS r1, round(r2, 6) AS r2, ex BETWEEN -4 AND 4 AND ey BETWEEN -3 AND 3 AS hit, CAST(ceil((r2 - r1) * sqrt(13::DOUBLE) * 2) AS INTEGER) AS n_free FROM s WHERE r1 < r2"""
)
def occupancy_ray_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = marks(spark, sf_dir).select("pt_idx", "x", "y", (F.col("x") + 3).alias("ex"), (F.col("y") - 2).alias("ey"))
    return gridmap.ray_infos(r, [-4.0, -3.0], [4.0, 3.0], 2.0, 10.0).select("pt_idx", r6("r1"), r6("r2"), "hit", "n_free")
