"""Rays through grids: traversal, casting, lines of pixels and sphere tracing.

A ray crosses |end - start| borders on each axis, at times that are arithmetic; ordered by time, running counts of the
crossings are the cells. A kernel on Arrow batches sorts the crossings of many rays at once: no loop over cells or
rays, and each ray's cells are made where the ray is, without a shuffle. Ties go to y before x in the plane and x, y, z in space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from orbweave.functions.keys import TreeSetting, prefix


#: Cells made at once by a kernel.
CELLS = 1 << 20


def _keys(x: np.ndarray, s: TreeSetting) -> tuple[np.ndarray, np.ndarray]:
    """(keys, inside) of coordinates, as checked_key has them."""
    cells = x / s.resolution
    inside = (cells >= -s.offset) & (cells < s.offset)
    return np.floor(np.where(inside, cells, 0)).astype(np.int64) + s.offset, inside


def walk_cells(starts: np.ndarray, ends: np.ndarray, s: TreeSetting, include_end: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ray, step, keys) of the cells of rays (n, axes), about CELLS at once; rays with an end beyond the tree have none."""
    (k0, in0), (k1, in1) = _keys(starts, s), _keys(ends, s)
    some = np.flatnonzero((in0 & in1).all(1))
    counts = np.abs(k1 - k0)[some].sum(1) + 1
    part = np.cumsum(counts) // CELLS
    for mine in np.split(some, np.flatnonzero(np.diff(part)) + 1):
        if len(mine):
            yield _walk(mine, starts[mine], ends[mine], k0[mine], k1[mine], s, include_end)


def _walk(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, k0: np.ndarray, k1: np.ndarray, s: TreeSetting, include_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, axes = starts.shape
    toward = np.where(k1 >= k0, 1, -1)
    ray, t, axis, number = [np.arange(n)], [np.full(n, -np.inf)], [np.full(n, -1)], [np.full(n, -1)]  # each ray's own cell comes first
    for j in range(axes):
        m = np.abs(k1[:, j] - k0[:, j])
        of = np.repeat(np.arange(n), m)
        i = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        border = k0[of, j] - s.offset + (k1[of, j] >= k0[of, j]) + toward[of, j] * i
        ray.append(of)
        t.append((border * s.resolution - starts[of, j]) / (ends[of, j] - starts[of, j]))
        axis.append(np.full(len(of), j))
        number.append(i)
    ray, t, axis, number = (np.concatenate(x) for x in (ray, t, axis, number))
    order = np.lexsort((number, -axis if axes == 2 else axis, t, ray))
    ray, axis = ray[order], axis[order]
    first = np.searchsorted(ray, np.arange(n))
    step = np.arange(len(ray)) - first[ray]
    keys = np.empty((len(ray), axes), np.int64)
    for j in range(axes):
        crossed = np.cumsum(axis == j)
        keys[:, j] = k0[ray, j] + toward[ray, j] * (crossed - crossed[first][ray])
    if not include_end:
        last = np.append(ray[1:] != ray[:-1], True)
        ray, step, keys = ray[~last], step[~last], keys[~last]
    return ids[ray], step, keys


def _floats(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)


def ray_cells(rays: DataFrame, starts: list[str], ends: list[str], s: TreeSetting, include_end: bool = False) -> DataFrame:
    """All columns of rays with step and a key for each axis (kx, ky[, kz]), a row for each cell from the start's to before the end's.

    A ray within one cell has no cells (its one cell with include_end); rays that leave the tree have none.
    """
    names = ["kx", "ky", "kz"][: len(starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ray, step, keys in walk_cells(_floats(b, starts), _floats(b, ends), s, include_end):
                rows = b.take(pa.array(ray))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(step.astype(np.int32)), *(pa.array(keys[:, j].astype(np.int32)) for j in range(len(names)))], [*rows.schema.names, "step", *names])

    schema = StructType([*rays.schema.fields, *(StructField(c, IntegerType()) for c in ("step", *names))])
    return rays.mapInArrow(run, schema)


def crossed_cells(rays: DataFrame, by: str, starts: list[str], ends: list[str], s: TreeSetting) -> DataFrame:
    """by (a whole number), kx, ky[, kz]: the cells that rays cross, each once for about CELLS cells made, so that little is shuffled."""
    names = ["kx", "ky", "kz"][: len(starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy(zero_copy_only=False)
            for ray, _, keys in walk_cells(_floats(b, starts), _floats(b, ends), s):
                code = keys[:, 0]
                for j in range(1, len(names)):
                    code = code << 20 | keys[:, j]
                order = np.lexsort((code, of[ray]))
                code, frame = code[order], of[ray][order]
                fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (frame[1:] != frame[:-1])]) if len(code) else np.zeros(0, bool)
                code, frame = code[fresh], frame[fresh]
                parts = [(code >> 20 * (len(names) - 1 - j) & 0xFFFFF).astype(np.int32) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(frame), *map(pa.array, parts)], [by, *names])

    return rays.select(F.col(by).cast("long").alias(by), *starts, *ends).mapInArrow(run, f"`{by}` long, " + ", ".join(f"{k} int" for k in names))


def cell_coordinates(cells: DataFrame, s: TreeSetting, axes: int = 2) -> DataFrame:
    from orbweave.functions.keys import centre

    return cells.select("*", *[centre(k, s).alias(c) for k, c in zip(["kx", "ky", "kz"][:axes], ["cx", "cy", "cz"][:axes], strict=True)])


def search_cells(cells: DataFrame, leaves: DataFrame, s: TreeSetting, keys: list[str] | None = None) -> DataFrame:
    """All columns of cells with d and log_odds of the leaf that covers each (null: unknown).

    Leaves are of any depth: a cell asks for its block at each depth that leaves have, an equi-join instead of a range
    join. leaves: d, kx, ky[, kz] as keys at depth d, log_odds.
    """
    keys = keys or [k for k in ("kx", "ky", "kz") if k in cells.columns]
    depths = sorted(r[0] for r in leaves.select("d").distinct().collect())  # 17 at most
    if not depths:
        return cells.select("*", F.lit(None).cast("int").alias("d"), F.lit(None).cast("double").alias("log_odds"))
    known = leaves.select(F.col("d").alias("_d"), *[prefix(k, F.col("d"), s).alias(f"_p{i}") for i, k in enumerate(keys)], "log_odds")
    if len(depths) == 1:
        asked = cells.select("*", F.lit(depths[0]).alias("_d"), *[prefix(k, depths[0], s).alias(f"_p{i}") for i, k in enumerate(keys)])
        joined = asked.join(known, ["_d", *[f"_p{i}" for i in range(len(keys))]], "left")
        return joined.select(*cells.columns, F.when(F.col("log_odds").isNotNull(), F.col("_d")).alias("d"), "log_odds")
    marked = cells.withColumn("_row", F.monotonically_increasing_id())
    asked = marked.select("*", F.explode(F.array(*map(F.lit, depths))).alias("_d"))
    asked = asked.select("*", *[prefix(k, F.col("_d"), s).alias(f"_p{i}") for i, k in enumerate(keys)])
    found = asked.join(known, ["_d", *[f"_p{i}" for i in range(len(keys))]])
    deepest = found.groupBy(*keys).agg(F.max(F.struct("_d", "log_odds")).alias("_f"))
    return cells.join(deepest, keys, "left").select(*cells.columns, F.col("_f._d").alias("d"), F.col("_f.log_odds").alias("log_odds"))


def cast_rays(rays: DataFrame, ray_id: str, leaves: DataFrame, s: TreeSetting, starts: list[str], directions: list[str], max_range: float, ignore_unknown: bool = True) -> DataFrame:
    """ray_id, step and key of the first occupied cell of each ray, with the centre's distance; rays without a hit are left out.

    A ray starts in its own cell. It ends at max_range, or in unknown space unless that is ignored.
    """
    axes = len(starts)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in directions[1:]), F.col(directions[0]) * F.col(directions[0])))
    reach = max_range + s.resolution * 2
    far = rays.filter(size > 0).select(ray_id, *[F.col(c).alias(f"_a{i}") for i, c in enumerate(starts)], *[(F.col(a) + F.col(v) / size * reach).alias(f"_b{i}") for i, (a, v) in enumerate(zip(starts, directions, strict=True))])
    cells = ray_cells(far, [f"_a{i}" for i in range(axes)], [f"_b{i}" for i in range(axes)], s, include_end=True)
    names = ["kx", "ky", "kz"][:axes]
    from orbweave.functions.keys import centre

    gap = F.sqrt(sum(((centre(k, s) - F.col(f"_a{i}")) ** 2 for i, k in enumerate(names)), F.lit(0.0)))
    seen = search_cells(cells.withColumn("distance", gap).filter((F.col("distance") <= max_range) | (F.col("step") == 0)), leaves, s, names)
    stops = F.col("log_odds") >= s.threshold if ignore_unknown else F.col("log_odds").isNull() | (F.col("log_odds") >= s.threshold)
    first = seen.filter(stops).groupBy(ray_id).agg(F.min(F.struct("step", *names, "distance", "log_odds")).alias("_h"))
    return first.filter("_h.log_odds is not null").select(ray_id, "_h.step", *[f"_h.{k}" for k in names], "_h.distance")


def first_ray_of_cell(hits: DataFrame, ray_id: str, keys: list[str]) -> DataFrame:
    """Of the rays that hit one cell, the one with the smallest id."""
    rest = [c for c in hits.columns if c not in (ray_id, *keys)]
    return hits.groupBy(*keys).agg(F.min(F.struct(ray_id, *rest)).alias("_r")).select(f"_r.{ray_id}", *keys, *[f"_r.{c}" for c in rest])


def frontier(hits: DataFrame, ray_id: str, keys: list[str]) -> DataFrame:
    """Cells with the rays that hit them."""
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_list(ray_id)).alias("rays"))


def nodes_on_rays(rays: DataFrame, ray_id: str, leaves: DataFrame, s: TreeSetting, starts: list[str], directions: list[str], max_range: float, padding: float = 0.0, both_ways: bool = False, min_depth: int = 0, max_depth: int | None = None, coarse: int = 6) -> DataFrame:
    """ray_id, leaf, near, far, rank: the leaves whose padded box a ray meets, nearest first, those behind it last.

    Leaves and rays meet in blocks at depth `coarse` that the ray passes, and leaves above it in the blocks at their own depth that hold those.
    """
    from orbweave.functions.geometry import ray_box
    from orbweave.functions.keys import centre, node_size

    axes = len(starts)
    names = ["kx", "ky", "kz"][:axes]
    block = TreeSetting(resolution=s.resolution * 2 ** (s.depth - coarse), depth=coarse)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in directions[1:]), F.col(directions[0]) * F.col(directions[0])))
    unit = rays.filter(size > 0).select(ray_id, *[F.col(a).alias(f"_a{i}") for i, a in enumerate(starts)], *[(F.col(v) / size).alias(f"_v{i}") for i, v in enumerate(directions)])
    reach = [(1, "_b")] + ([(-1, "_b")] if both_ways else [])
    edge = s.resolution * s.offset * 0.999999
    passed = None
    for sign, _ in reach:
        ended = unit.select("*", *[F.greatest(F.lit(-edge), F.least(F.lit(edge), F.col(f"_a{i}") + sign * F.col(f"_v{i}") * max_range)).alias(f"_b{i}") for i in range(axes)])
        cells = ray_cells(ended, [f"_a{i}" for i in range(axes)], [f"_b{i}" for i in range(axes)], block, include_end=True).select(ray_id, *[f"_a{i}" for i in range(axes)], *[f"_v{i}" for i in range(axes)], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)])
        passed = cells if passed is None else passed.unionByName(cells)
    grow = 1 if padding <= block.resolution else int(padding / block.resolution) + 1
    around = F.array(*map(F.lit, range(-grow, grow + 1)))
    for i in range(axes):
        passed = passed.withColumn(f"_o{i}", F.explode(around)).withColumn(f"_k{i}", F.col(f"_k{i}") + F.col(f"_o{i}")).drop(f"_o{i}")
    passed = passed.distinct()
    level = F.explode(F.sequence(F.lit(min(min_depth, coarse)), F.lit(coarse)))
    passed = passed.withColumn("_d", level).withColumns({f"_k{i}": F.floor(F.col(f"_k{i}") / F.pow(F.lit(2.0), F.lit(coarse) - F.col("_d"))).cast("int") for i in range(axes)}).distinct()
    kept = leaves.filter((F.col("d") >= min_depth) & (F.col("d") <= (s.depth if max_depth is None else max_depth)))
    at = F.least(F.col("d"), F.lit(coarse)).cast("int")
    placed = kept.select("d", *names, "log_odds", at.alias("_d"), *[prefix(k, at, s).alias(f"_k{i}") for i, k in enumerate(names)])
    met = passed.join(placed, ["_d", *[f"_k{i}" for i in range(axes)]])
    low = [centre(k, s, F.col("d")) - node_size(F.col("d"), s) / 2 - padding for k in names]
    high = [centre(k, s, F.col("d")) + node_size(F.col("d"), s) / 2 + padding for k in names]
    hit, near, far = ray_box([f"_a{i}" for i in range(axes)], [f"_v{i}" for i in range(axes)], low, high)
    met = met.withColumn("_hit", hit).withColumn("near", near).withColumn("far", far).filter("_hit").filter(F.abs("near") <= max_range)
    met = met if both_ways else met.filter("far >= 0")
    met = met.select(ray_id, "d", *names, "log_odds", "near", "far").distinct()
    order = Window.partitionBy(ray_id).orderBy(F.col("far") < 0, F.abs("near"), "d", *names)
    return met.withColumn("rank", F.row_number().over(order))


def bresenham(lines: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """All columns of lines with step, px, py: the pixels of each line, both ends included."""
    dx, dy = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    n = F.greatest(F.abs(dx), F.abs(dy))
    made = lines.select("*", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("step"))
    # the minor axis moves by the nearest whole number, halves toward the start
    minor = lambda d: F.when(n == 0, 0).otherwise(F.signum(d) * F.floor((2 * F.col("step") * F.abs(d) + n - 1) / F.when(n == 0, 1).otherwise(2 * n))).cast("int")
    return made.select("*", (F.col(x0) + minor(dx)).cast("int").alias("px"), (F.col(y0) + minor(dy)).cast("int").alias("py"))


def bresenham_until(lines: DataFrame, line_id: str, x0: str, y0: str, x1: str, y1: str, stop: Callable[[Column, Column], Column]) -> DataFrame:
    """The pixels of each line before the first at which stop(px, py) holds."""
    pixels = bresenham(lines, x0, y0, x1, y1)
    held = F.min(F.when(stop(F.col("px"), F.col("py")), F.col("step"))).over(Window.partitionBy(line_id))
    return pixels.withColumn("_stop", held).filter("_stop is null or step < _stop").drop("_stop")


def polygon_pixels(lines: DataFrame) -> DataFrame:
    """obj_id, line_id, step, px, py: the pixels of polygons' contours; a line's last pixel is the next line's first and is left out."""
    at = lines.select("obj_id", "line_id", *[F.floor(c).cast("int").alias(c) for c in ("ax", "ay", "bx", "by")])
    made = bresenham(at, "ax", "ay", "bx", "by")
    point = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    last = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    return made.filter((F.col("step") < last) | point).select("obj_id", "line_id", "step", "px", "py")


def sphere_trace(rays: DataFrame, starts: list[str], directions: list[str], distance: Callable[[list[Column]], Column], max_range: float, steps: int = 64, tolerance: float = 1e-6) -> DataFrame:
    """All columns of rays with t and hit: how far each unit ray goes until the distance function is within the tolerance.

    A ray that starts inside goes forward to where it leaves. One that only just touches may take more than `steps` and is then no hit.
    """
    at = lambda t: [F.col(a) + F.col(v) * t for a, v in zip(starts, directions, strict=True)]
    side = F.when(distance([F.col(a) for a in starts]) < 0, -1.0).otherwise(1.0)
    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda t, _: F.when(t > max_range, t).otherwise(t + side * distance(at(t))))
    traced = rays.withColumn("t", t)
    return traced.withColumn("hit", (F.col("t") <= max_range) & (F.abs(distance(at(F.col("t")))) <= tolerance * 10))
