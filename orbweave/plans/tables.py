"""Geometric tables derived from the star-schema test tables, by whole numbers first so that every engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates are whole numbers times this, exact in binary.
UNIT = 0.03125


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(n: str, span: int) -> Column:
    return F.expr(f"({n}) % {span} - {span // 2}").cast("double") * F.lit(UNIT)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, z of line items; a row for each."""
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey % 16").alias("frame"), _at("l_partkey * 37 + l_linenumber * 11", 801).alias("x"), _at("l_suppkey * 53 + l_orderkey * 7", 601).alias("y"), _at("l_partkey * 13 + l_suppkey * 5", 401).alias("z"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_idx, frame, x, y, z of events; ids are unique."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pt_idx"), F.expr("user_id % 8").alias("frame"), _at("event_id * 7919 + user_id * 31", 641).alias("x"), _at("event_id * 104729 + user_id * 17", 481).alias("y"), _at("event_id * 1299709", 321).alias("z"))


#: The same as SQL, for the oracles.
POINTS_SQL = f"""SELECT l_orderkey % 16 AS frame, CAST((l_partkey * 37 + l_linenumber * 11) % 801 - 400 AS DOUBLE) * {UNIT}::DOUBLE AS x,
  CAST((l_suppkey * 53 + l_orderkey * 7) % 601 - 300 AS DOUBLE) * {UNIT}::DOUBLE AS y, CAST((l_partkey * 13 + l_suppkey * 5) % 401 - 200 AS DOUBLE) * {UNIT}::DOUBLE AS z FROM lineitem"""
MARKS_SQL = f"""SELECT event_id AS pt_idx, user_id % 8 AS frame, CAST((event_id * 7919 + user_id * 31) % 641 - 320 AS DOUBLE) * {UNIT}::DOUBLE AS x,
  CAST((event_id * 104729 + user_id * 17) % 481 - 240 AS DOUBLE) * {UNIT}::DOUBLE AS y, CAST((event_id * 1299709) % 321 - 160 AS DOUBLE) * {UNIT}::DOUBLE AS z FROM events"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, line_id, ax, ay, bx, by: a square for each nation, some overlapping."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("obj_id"), _at("n_nationkey * 97", 401).alias("cx"), _at("n_nationkey * 61", 301).alias("cy"), ((F.col("n_nationkey") % 5 + 1) * 0.25).alias("h"))
    ring = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), c, strict=True)]) for c in ((-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1))])
    return n.select("*", F.posexplode(ring).alias("line_id", "r")).select("obj_id", "line_id", *[(F.col("c" + k[1]) + F.col("h") * F.col(f"r.{k}")).alias(k) for k in ("ax", "ay", "bx", "by")])


LINES_SQL = f"""SELECT CAST(n_nationkey AS INTEGER) AS obj_id, line_id, cx + h * ux AS ax, cy + h * uy AS ay, cx + h * vx AS bx, cy + h * vy AS b_y FROM
  (SELECT n_nationkey, CAST(n_nationkey * 97 % 401 - 200 AS DOUBLE) * {UNIT}::DOUBLE AS cx, CAST(n_nationkey * 61 % 301 - 150 AS DOUBLE) * {UNIT}::DOUBLE AS cy, (n_nationkey % 5 + 1) * 0.25::DOUBLE AS h FROM nation) n,
  (VALUES (0, -1.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE), (1, 1.0, -1.0, 1.0, 1.0), (2, 1.0, 1.0, -1.0, 1.0), (3, -1.0, 1.0, -1.0, -1.0)) AS r(line_id, ux, uy, vx, vy)"""
