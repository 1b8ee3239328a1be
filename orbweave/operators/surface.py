"""Polygons in the plane as lines: distances, directional distances and inside tests of points against them.

A surface is a table of directed lines (obj_id, line_id, ax, ay, bx, by). Lines that number BROADCAST at most (checked) are
broadcast to the points; distances and inside tests meet larger surfaces through grid cells and bands. Rays meet
all lines, and refuse larger surfaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import norm, point_segment_distance, ray_segment, sub, winding_term
from orbweave.operators.neighbors import nearest
from orbweave.sources.shared import settle

#: Lines that may be broadcast.
BROADCAST = 20_000


def close_polygons(vertices: DataFrame, obj: str = "obj_id", order: str = "vid", x: str = "x", y: str = "y") -> DataFrame:
    """Lines of closed polygons from ordered vertices."""
    w = Window.partitionBy(obj).orderBy(order)
    every = Window.partitionBy(obj).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    return vertices.select(F.col(obj).alias("obj_id"), F.col(order).cast("int").alias("line_id"), F.col(x).alias("ax"), F.col(y).alias("ay"), nxt(x).alias("bx"), nxt(y).alias("by"))


def vertex_neighbours(vertices: DataFrame, obj: str = "obj_id", order: str = "vid") -> DataFrame:
    """Each vertex with the one before and after it around its polygon."""
    w = Window.partitionBy(obj).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select("*", F.coalesce(F.lag(order).over(w), F.last(order).over(every)).alias("before"), F.coalesce(F.lead(order).over(w), F.first(order).over(every)).alias("after"))


def add_obstacles(surface: DataFrame, more: DataFrame) -> DataFrame:
    """More objects, numbered after the others."""
    last = surface.agg(F.coalesce(F.max("obj_id") + 1, F.lit(0))).first()[0]
    return surface.unionByName(more.withColumn("obj_id", F.col("obj_id") + last))


def translate(surface: DataFrame, dx: float, dy: float) -> DataFrame:
    return surface.select("obj_id", "line_id", (F.col("ax") + dx).alias("ax"), (F.col("ay") + dy).alias("ay"), (F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"))


def small(lines: DataFrame) -> bool:
    return lines.limit(BROADCAST + 1).count() <= BROADCAST


def meet_lines(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Every point with every line; refuses surfaces too large for that."""
    if not small(lines):
        raise ValueError(f"more than {BROADCAST} lines: cut the surface into tiles")
    return points.withColumn("_all", F.lit(1)).join(F.broadcast(lines.withColumn("_all", F.lit(1))), "_all").drop("_all")


def bands(lines: DataFrame, most: int = 1 << 14) -> tuple[DataFrame, float]:
    """(lines, height): each line in every band of y that it passes, and the bands' height: about a line's, `most` bands over all at most."""
    h, low, high = lines.agg(F.avg(F.abs(F.col("by") - F.col("ay"))), F.least(F.min("ay"), F.min("by")), F.greatest(F.max("ay"), F.max("by"))).first()
    height = max(h or 0.0, ((high or 0.0) - (low or 0.0)) / most, 1e-9)
    band = lambda y: F.floor(y / F.lit(height))
    return lines.withColumn("_band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))), height


def winding_numbers(points: DataFrame, point_id: str, lines: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """point_id, obj_id, winding of every point around every polygon that passes its height.

    A surface of few lines is broadcast; in a larger one only lines that pass a point's height count, found by an equi-join on bands of y.
    """
    asked = points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y"))
    if small(lines):
        met = meet_lines(asked, lines)
    else:
        banded, height = bands(lines)
        met = asked.withColumn("_band", F.floor(F.col("_y") / F.lit(height))).join(banded, "_band")
    term = winding_term(["_x", "_y"], ["ax", "ay"], ["bx", "by"])
    return met.groupBy(point_id, "obj_id").agg(F.sum(term).cast("long").alias("winding"))


def nearest_lines(points: DataFrame, point_id: str, lines: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """point_id, d, obj_id, line_id of the nearest line; ties go to the smallest object and line.

    A surface of few lines is broadcast. In a larger one each line is in the cells that its box covers, and a point looks in the
    cells around its own; what is farther than a cell looks again with cells twice as wide, until they reach over everything.
    """
    asked = points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y"))
    best = F.min(F.struct(point_segment_distance(["_x", "_y"], ["ax", "ay"], ["bx", "by"]).alias("d"), "obj_id", "line_id")).alias("m")
    if small(lines):
        return meet_lines(asked, lines).groupBy(point_id).agg(best).select(point_id, "m.d", "m.obj_id", "m.line_id")
    size = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    ends = lines.select(F.col("ax").alias("_x"), F.col("ay").alias("_y")).unionByName(lines.select(F.col("bx").alias("_x"), F.col("by").alias("_y"))).unionByName(asked.select("_x", "_y"))
    box = ends.agg(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).first()
    reach = max(box[0] or 0.0, box[1] or 0.0) * 1.5
    width, out = max(lines.agg(F.avg(size)).first()[0] or 0.0, reach / (1 << 14), 1e-9), None
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        cell = lambda v: F.floor(v / F.lit(width))  # noqa: B023, E731
        placed = lines.select("*", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx")))).alias("_i")).select("*", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))).alias("_j"))
        around = asked.select("*", F.explode(near).alias("_o")).select(point_id, "_x", "_y", (cell(F.col("_x")) + F.col("_o.i")).alias("_i"), (cell(F.col("_y")) + F.col("_o.j")).alias("_j"))
        found = around.join(placed, ["_i", "_j"]).groupBy(point_id).agg(best).select(point_id, "m.d", "m.obj_id", "m.line_id")
        if width >= reach:
            return found if out is None else out.unionByName(found)
        found = settle(found.filter(F.col("d") <= width), "nearest-lines")
        out = found if out is None else out.unionByName(found)
        asked = settle(asked.join(found.select(point_id), point_id, "left_anti"), "nearest-left")
        if asked.isEmpty():
            return out
        width *= 2


def points_in_polygons(points: DataFrame, point_id: str, lines: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return winding_numbers(points, point_id, lines, x, y).filter("winding <> 0").select(point_id, "obj_id")


def signed_distance(points: DataFrame, point_id: str, lines: DataFrame, outside: DataFrame | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """point_id, sdf, obj_id, line_id: distance to the nearest line, negative inside its polygon.

    outside: obj_id, outside: polygons that are the space's outer walls have their inside positive (outside = false).
    Ties go to the smallest object and line.
    """
    if small(lines):
        met = meet_lines(points.select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y")), lines)
        near = F.min(F.struct(point_segment_distance(["_x", "_y"], ["ax", "ay"], ["bx", "by"]).alias("d"), F.col("obj_id").alias("o"), F.col("line_id").alias("l"))).alias("m")
        by = met.groupBy(point_id, "obj_id").agg(near, F.sum(winding_term(["_x", "_y"], ["ax", "ay"], ["bx", "by"])).alias("w"))
        best = by.groupBy(point_id).agg(F.min(F.struct("m", "w")).alias("b")).select(point_id, F.col("b.m.d").alias("d"), F.col("b.m.o").alias("obj_id"), F.col("b.m.l").alias("line_id"), (F.col("b.w") != 0).alias("inside"))
    else:
        best = nearest_lines(points, point_id, lines, x, y).join(winding_numbers(points, point_id, lines, x, y), [point_id, "obj_id"], "left")
        best = best.select(point_id, "d", "obj_id", "line_id", (F.coalesce("winding", F.lit(0)) != 0).alias("inside"))
    if outside is not None:
        best = best.join(F.broadcast(outside.select("obj_id", "outside")), "obj_id", "left")
        negative = F.col("inside") == F.coalesce("outside", F.lit(True))
    else:
        negative = F.col("inside")
    return best.select(point_id, F.when(negative, -F.col("d")).otherwise(F.col("d")).alias("sdf"), "obj_id", "line_id")


def vertex_distance(points: DataFrame, point_id: str, lines: DataFrame, normals: DataFrame, width: float, x: str = "x", y: str = "y") -> DataFrame:
    """point_id, sdf, obj_id, vid: distance to the nearest vertex (line_id names a line's first), negative behind its normal (obj_id, line_id, nx, ny)."""
    vertices = lines.select(F.struct("obj_id", "line_id").alias("_v"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    asked = points.select(F.col(point_id).alias("_q"), F.col(x).alias("x"), F.col(y).alias("y"))
    found = nearest(asked, vertices, "_q", "_v", ["x", "y"], width)
    named = found.select(F.col("query").alias("_q"), "point.obj_id", "point.line_id", "distance").join(asked, "_q").join(lines.select("obj_id", "line_id", "ax", "ay"), ["obj_id", "line_id"]).join(normals, ["obj_id", "line_id"])
    return named.select(F.col("_q").alias(point_id), (F.col("distance") * sign_by_normal(["x", "y"], ["ax", "ay"], ["nx", "ny"])).alias("sdf"), "obj_id", F.col("line_id").alias("vid"))


def sign_by_normal(p: list, foot: list, normal: list) -> Column:
    """-1 behind a point with a normal, else 1."""
    from orbweave.functions.geometry import dot

    return F.when(dot(sub(p, foot), normal) < 0, -1.0).otherwise(1.0)


def vertex_normals(lines: DataFrame, delta: float = 1e-3) -> DataFrame:
    """obj_id, line_id, nx, ny at each line's first vertex: the gradient of the signed distance by central differences."""
    moved = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(((delta, 0.0), (-delta, 0.0), (0.0, delta), (0.0, -delta)))])
    at = lines.select(F.struct("obj_id", "line_id").alias("_v"), "ax", "ay", F.explode(moved).alias("_m")).select(F.struct("_v", "_m.i").alias("_p"), (F.col("ax") + F.col("_m.dx")).alias("x"), (F.col("ay") + F.col("_m.dy")).alias("y"))
    d = signed_distance(at, "_p", lines).select("_p._v", "_p.i", "sdf")
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("sdf")))
    g = d.groupBy("_v").agg((pick(0) - pick(1)).alias("gx"), (pick(2) - pick(3)).alias("gy"))
    size = norm(["gx", "gy"])
    return g.select("_v.obj_id", "_v.line_id", (F.col("gx") / F.when(size > 0, size)).alias("nx"), (F.col("gy") / F.when(size > 0, size)).alias("ny"))


def outside_flags(vertices: DataFrame, obj: str = "obj_id") -> DataFrame:
    """obj_id, outside: whether an object's normals (nx, ny) point away from its centre on average."""
    w = Window.partitionBy(obj)
    d = vertices.withColumn("_dx", F.col("x") - F.avg("x").over(w)).withColumn("_dy", F.col("y") - F.avg("y").over(w))
    return d.groupBy(F.col(obj).alias("obj_id")).agg((F.avg(F.col("_dx") * F.col("nx") + F.col("_dy") * F.col("ny")) > 0).alias("outside"))


def _along(rays: DataFrame, ray_id: str, lines: DataFrame, start: list[str], direction: list[str]) -> DataFrame:
    """ray_id, t of every line that a ray's line crosses."""
    size = norm(direction)
    unit = rays.select(ray_id, F.col(start[0]).alias("_x"), F.col(start[1]).alias("_y"), *[(F.col(c) / F.when(size > 0, size)).alias(f"_v{i}") for i, c in enumerate(direction)])
    met = meet_lines(unit, lines)
    weight, t = ray_segment(["_x", "_y"], ["_v0", "_v1"], ["ax", "ay"], ["bx", "by"])
    return met.select(ray_id, F.when(weight.between(0, 1), t).alias("t"))


def directional_distance(rays: DataFrame, ray_id: str, lines: DataFrame, start: list[str] = ("x", "y"), direction: list[str] = ("vx", "vy")) -> DataFrame:
    """ray_id, distance to the first line ahead; infinite if there is none."""
    t = _along(rays, ray_id, lines, list(start), list(direction))
    return t.groupBy(ray_id).agg(F.coalesce(F.min(F.when(F.col("t") >= 0, F.col("t"))), F.lit(float("inf"))).alias("distance"))


def signed_directional_distance(rays: DataFrame, ray_id: str, lines: DataFrame, start: list[str] = ("x", "y"), direction: list[str] = ("vx", "vy")) -> DataFrame:
    """ray_id, distance to the first line on the whole line of the ray, behind counting negative; infinite if there is none."""
    t = _along(rays, ray_id, lines, list(start), list(direction))
    return t.groupBy(ray_id).agg(F.coalesce(F.min("t"), F.lit(float("inf"))).alias("distance"))


def signed_directional_distance_inside(rays: DataFrame, ray_id: str, lines: DataFrame, start: list[str] = ("x", "y"), direction: list[str] = ("vx", "vy"), outside: DataFrame | None = None) -> DataFrame:
    """Ahead for points outside, else the nearest line behind (not positive)."""
    t = _along(rays, ray_id, lines, list(start), list(direction))
    ahead, behind = F.min(F.when(F.col("t") >= 0, F.col("t"))), F.max(F.when(F.col("t") <= 0, F.col("t")))
    both = t.groupBy(ray_id).agg(ahead.alias("ahead"), behind.alias("behind"))
    side = signed_distance(rays, ray_id, lines, outside, *start).select(ray_id, (F.col("sdf") < 0).alias("inside"))
    return both.join(side, ray_id).select(ray_id, F.when(F.col("inside"), F.coalesce("behind", F.lit(float("-inf")))).otherwise(F.coalesce("ahead", F.lit(float("inf")))).alias("distance"))


def grid_points(df: DataFrame, rows: int, cols: int, x0: float, y0: float, step: float) -> DataFrame:
    """row, col, x, y of a grid; df gives the session."""
    g = df.sparkSession.range(rows * cols)
    row, col = F.floor(F.col("id") / cols).cast("int"), (F.col("id") % cols).cast("int")
    return g.select("id", row.alias("row"), col.alias("col"), (F.lit(float(x0)) + col * float(step)).alias("x"), (F.lit(float(y0)) + row * float(step)).alias("y"))


def distance_image(lines: DataFrame, rows: int, cols: int, x0: float, y0: float, step: float, outside: DataFrame | None = None) -> DataFrame:
    g = grid_points(lines, rows, cols, x0, y0, step)
    return signed_distance(g, "id", lines, outside).join(g.select("id", "row", "col"), "id").select("row", "col", "sdf")


def rasterise(lines: DataFrame, outside: DataFrame, rows: int, cols: int, x0: float, y0: float, step: float) -> DataFrame:
    """row, col, value: 255 inside a polygon, 0 inside a hole (outside = true); the last object that holds a pixel decides."""
    g = grid_points(lines, rows, cols, x0, y0, step)
    held = points_in_polygons(g, "id", lines).join(F.broadcast(outside), "obj_id")
    last = held.groupBy("id").agg(F.max_by("outside", "obj_id").alias("hole"))
    return g.join(last, "id", "left").select("row", "col", F.when(F.col("hole") == F.lit(False), 255).otherwise(0).alias("value"))
