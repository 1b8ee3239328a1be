"""Queries over sources: each writes files of a format from the test tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import tree
from orbweave.plans.queries import _AT, _BLOCKY, _LEAVES, _P, _PRUNED, S, T, _blocky, _key, query, r6
from orbweave.plans.tables import LINES_SQL, lines, points, table
from orbweave.sources import maps
from orbweave.sources.shared import shared_path


def _text(rows: DataFrame, name: str) -> str:
    """The path of a text file of rows (n, value) in order."""
    path = shared_path(rows.sparkSession, name)
    rows.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.text(path)
    return path


def _rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array_sort(F.collect_list(F.struct("line_id", "ax", "ay")))
    box = F.struct(F.array(F.min("ax"), F.min("ay")).alias("min"), F.array(F.max("ax"), F.max("ay")).alias("max"))
    rooms = lines(spark, sf_dir).groupBy(F.col("obj_id").cast("string").alias("id")).agg(box.alias("bbox"), F.transform(corners, lambda c: F.array(c["ax"], c["ay"])).alias("verts"))
    path = shared_path(spark, "rooms")
    maps.write_rooms(rooms, path)
    return spark.read.schema(maps.ROOM).json(path)


@query(f"SELECT CAST(obj_id AS VARCHAR) AS id, CAST(line_id AS INTEGER) AS vid, ax AS x, ay AS y FROM ({LINES_SQL})")
def room_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.room_vertices(_rooms(spark, sf_dir))


@query("SELECT floor(area / 5) * 5 AS bucket, count(*) AS count, string_agg(id, ' ' ORDER BY id) AS ids FROM (SELECT CAST(n_nationkey AS VARCHAR) AS id, pow((n_nationkey % 5 + 1) * 0.5, 2) AS area FROM nation) GROUP BY 1")
def room_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.room_size_statistics(_rooms(spark, sf_dir), 5.0).select(F.col("bucket").cast("double").alias("bucket"), "count", F.concat_ws(" ", "ids").alias("ids"))


@query("SELECT CAST(p_partkey // 16 AS INTEGER) AS row, CAST(p_partkey % 16 AS INTEGER) AS col, p_partkey % 3 <> 0 AS passable FROM part WHERE p_partkey < (SELECT count(*) // 16 * 16 FROM part)")
def street_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of 16 parts as a street map: '.', 'G' and '@', with rows and columns beyond the header's size."""
    p = table(spark, sf_dir, "part")
    rows = p.count() // 16
    cell = F.when(F.col("p_partkey") % 3 == 0, "@").when(F.col("p_partkey") % 3 == 1, ".").otherwise("G")
    body = p.filter(F.col("p_partkey") < rows * 16).groupBy(F.expr("p_partkey div 16").alias("n")).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cell.alias("c")))), lambda e: e["c"]), ""), F.lit("..")).alias("value"))
    head = spark.createDataFrame([(-4, "type octile"), (-3, f"height {rows}"), (-2, "width 16"), (-1, "map"), (1 << 40, "." * 16)], "n long, value string")
    return maps.read_street_map(spark, _text(head.unionByName(body), "streets")).select("row", "col", "passable")


@query("SELECT CAST(o_orderkey % 100 AS INTEGER) AS bucket, 'm' || CAST(o_orderkey % 7 AS VARCHAR) AS map, 64 AS map_width, 48 AS map_height, CAST(o_orderkey % 64 AS INTEGER) AS start_x, CAST(o_custkey % 48 AS INTEGER) AS start_y, CAST(o_custkey % 64 AS INTEGER) AS goal_x, CAST(o_orderkey % 48 AS INTEGER) AS goal_y, o_orderkey / 8.0::DOUBLE AS optimal_length FROM orders")
def scenario_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fields = ["o_orderkey % 100", "concat('m', o_orderkey % 7)", "64", "48", "o_orderkey % 64", "o_custkey % 48", "o_custkey % 64", "o_orderkey % 48", "o_orderkey / 8.0D"]
    path = shared_path(spark, "scenes")
    o.select(F.concat_ws("\t", *[F.expr(f"cast({f} as string)") for f in fields]).alias("value")).unionByName(spark.createDataFrame([("version 1",)], "value string")).write.text(path)
    return maps.read_scenes(spark, path)


_POSE = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS frame_id, s_suppkey * 0.25::DOUBLE AS tx, s_suppkey * 0.5::DOUBLE - 3 AS ty, s_suppkey * 0.125::DOUBLE AS a FROM supplier"


def _poses(spark: SparkSession, sf_dir: str, columns: list[str], kind: str, comment: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat_ws(",", *[F.expr(f"cast({c} as string)") for c in columns]).alias("value"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "# a pose a line")], "n long, value string")) if comment else rows
    return maps.read_trajectory(spark, _text(rows, "poses"), kind)


@query(f"SELECT frame_id, tx, ty, a AS theta, round(cos(a), 6) AS c, round(-sin(a), 6) AS s, tx AS mx, ty AS my FROM ({_POSE})")
def plane_trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _poses(spark, sf_dir, ["s_suppkey * 0.25D", "s_suppkey * 0.5D - 3", "s_suppkey * 0.125D"], "se2", True)
    m = maps.pose_matrix(p, "se2")
    return p.join(m, "frame_id").select("frame_id", "tx", "ty", "theta", r6(F.col("m")[0], "c"), r6(F.col("m")[1], "s"), F.col("m")[3].alias("mx"), F.col("m")[7].alias("my"))


@query(f"SELECT frame_id, tx, ty, tx + 1 AS tz, round(cos(a), 6) AS m00, round(-sin(a), 6) AS m01, round(sin(a), 6) AS m10, 1.0::DOUBLE AS m22 FROM ({_POSE})")
def space_trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions of turns about z, not of unit length."""
    p = _poses(spark, sf_dir, ["s_suppkey * 0.25D", "s_suppkey * 0.5D - 3", "s_suppkey * 0.25D + 1", "0D", "0D", "2 * sin(s_suppkey * 0.0625D)", "2 * cos(s_suppkey * 0.0625D)"], "se3")
    m = maps.pose_matrix(p, "se3")
    return p.join(m, "frame_id").select("frame_id", "tx", "ty", "tz", *[r6(F.col("m")[i], n) for i, n in ((0, "m00"), (1, "m01"), (4, "m10"), (10, "m22"))])


@query(f"SELECT frame_id, tx, ty FROM ({_POSE})")
def point_trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poses(spark, sf_dir, ["s_suppkey * 0.25D", "s_suppkey * 0.5D - 3"], "2d").select("frame_id", "tx", "ty")


def _ply(spark: SparkSession, sf_dir: str) -> str:
    """Squares as a PLY file of points and faces of four corners."""
    v = lines(spark, sf_dir).select((F.col("obj_id") * 4 + F.col("line_id")).alias("n"), F.concat_ws(" ", "ax", "ay", F.col("obj_id") * 0.5).alias("value"))
    n = v.count()
    f = v.filter("n % 4 = 0").select((F.col("n") + 1_000_000).alias("n"), F.concat_ws(" ", F.lit(4), *[F.col("n") + i for i in range(4)]).alias("value"))
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property float x", "property float y", "property float z", f"element face {n // 4}", "property list uchar int vertex_indices", "end_header"]
    rows = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "n long, value string")
    return _text(rows.unionByName(v).unionByName(f), "ply")


@query(f"SELECT obj_id * 4 + line_id AS vid, ax AS x, ay AS y, obj_id * 0.5::DOUBLE AS z FROM ({LINES_SQL})")
def ply_point_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.read_ply_vertices(spark, _ply(spark, sf_dir), "*.txt").select("vid", "x", "y", "z")


@query("SELECT n_nationkey * 2 + i AS fid, n_nationkey * 4 AS a, n_nationkey * 4 + 1 + i AS b, n_nationkey * 4 + 2 + i AS c FROM nation, unnest(range(0, 2)) AS u(i)")
def ply_face_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.read_ply_faces(spark, _ply(spark, sf_dir), "*.txt").select("fid", "a", "b", "c")


@query(f"WITH {_PRUNED}, q AS ({_LEAVES}) SELECT CAST(d AS INTEGER) AS d, {_AT('kx')} AS kx, {_AT('ky')} AS ky, v AS log_odds FROM q")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tree")
    maps.write_tree(tree.prune(_blocky(spark, sf_dir), T), T, path)
    return maps.read_tree(spark, path)[0].select("d", "kx", "ky", "log_odds")


@query(f"WITH {_BLOCKY}, o AS (SELECT kx, ky, CASE WHEN kx % 3 = 0 THEN -2.0::DOUBLE ELSE 3.5::DOUBLE END AS log_odds FROM b8) SELECT 8 AS d, kx, ky, log_odds FROM o")
def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in two bits a node, written and read."""
    path = shared_path(spark, "states")
    leaves = _blocky(spark, sf_dir).withColumn("log_odds", F.when(F.col("kx") % 3 == 0, -F.col("log_odds")).otherwise(F.col("log_odds")))
    maps.write_states(leaves, T, path)
    return maps.read_states(spark, path)[0].select("d", "kx", "ky", "log_odds")


@query(f"WITH {_P} SELECT DISTINCT {_key('x')} AS kx, {_key('y')} AS ky, 3.5::DOUBLE AS log_odds FROM p")
def map_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of updates folded into versions of a map; late frames in the second don't count."""
    from orbweave.streaming.ingest import Snapshots

    cells = tree.end_keys(points(spark, sf_dir), ["x", "y"], S).select("kx", "ky").distinct()
    told = cells.select(F.explode(F.sequence(F.lit(1), F.lit(8))).alias("frame"), "kx", "ky", F.lit(0.85).alias("delta"))
    kept = Snapshots(spark, shared_path(spark, "versions"), S)
    kept.merge(told.filter("frame <= 4"), 0)
    kept.merge(told.filter("frame > 4").unionByName(told.filter("frame = 2").withColumn("delta", F.lit(-9.0))), 1)
    return kept.read(1).select("kx", "ky", "log_odds")


@query("SELECT s_suppkey % 5 AS token, s_suppkey AS id, 't' || CAST(s_suppkey AS VARCHAR) AS labels, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 2 ELSE s_suppkey END AS score FROM supplier WHERE s_suppkey % 3 <> 1")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results corrected by a second table, without those of an unwanted label; names paired but for their ending."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("score"), F.array(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 3 == 1, "bad").otherwise("good")).alias("labels"))
    both = maps.merge_results(s, s.filter("id % 2 = 0").withColumn("score", F.col("score") * 2), "id")
    kept = maps.filter_results(both, ["bad"])
    names = spark.range(5).select(F.concat("id", F.lit(".json")).alias("file"))
    paired = maps.pair_files(kept.withColumn("file", F.concat(F.col("id") % 5, F.lit(".csv"))), names)
    return paired.select(F.col("token").cast("long").alias("token"), "id", F.col("labels")[0].alias("labels"), "score")
