"""Log-odds grid maps, masks, frontiers and training sets of occupancy."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geometry import norm, ray_box
from orbweave.functions.keys import TreeSetting


def update_map(updates: DataFrame, s: TreeSetting, free_below: float, occupied_above: float, frame: str = "frame") -> DataFrame:
    """row, col, log_odds, state of a grid after ordered updates (frame, row, col, delta), one a frame and cell.

    The state has hysteresis: between the thresholds it stays what it was (first unknown).
    """
    rows = updates.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct(frame, "delta"))).alias("_u"))
    start = F.struct(F.lit(0.0).alias("l"), F.lit("unknown").alias("state"))

    def step(acc: Column, u: Column) -> Column:
        value = F.least(F.greatest(acc["l"] + u["delta"], F.lit(s.log_odds_min)), F.lit(s.log_odds_max))
        return F.struct(value.alias("l"), F.when(value >= occupied_above, F.lit("occupied")).when(value <= free_below, F.lit("free")).otherwise(acc["state"]).alias("state"))

    return rows.select("row", "col", F.aggregate("_u", start, step).alias("_a")).select("row", "col", F.col("_a.l").alias("log_odds"), "_a.state")


def possibility_map(cells: DataFrame, value: str = "value") -> DataFrame:
    """Cells with log-odds from values -1 (unexplored: null) and 0 to 100 per cent (0 and 100: infinite)."""
    v = F.col(value)
    p = v / 100.0
    odds = F.when(v < 0, F.lit(None)).when(v == 0, F.lit(float("-inf"))).when(v == 100, F.lit(float("inf"))).otherwise(F.log(p / (F.lit(1.0) - p)))
    return cells.withColumn("log_odds", odds.cast("double"))


def state_counts(cells: DataFrame) -> DataFrame:
    """occupied, free, unknown and all cells; the three add up to the fourth."""
    n = lambda x: F.sum((F.col("state") == x).cast("long")).alias(x)
    return cells.agg(n("occupied"), n("free"), n("unknown"), F.count(F.lit(1)).alias("cells"))


def neighbourhood(cells: DataFrame, radius: int = 1, cross: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Every cell's row told to all cells within a square (or cross) around it."""
    offsets = [(i, j) for i, j in product(range(-radius, radius + 1), repeat=2) if not cross or i == 0 or j == 0]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    told = cells.select("row", "col", *(columns or []), F.explode(around).alias("_o"))
    return told.select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), *(columns or []))


def dilate(cells: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    """Set cells, and those near one."""
    return neighbourhood(cells, radius, cross).distinct()


def erode(cells: DataFrame, radius: int = 1, cross: bool = False) -> DataFrame:
    """Cells all of whose neighbourhood is set."""
    size = (2 * radius + 1) ** 2 if not cross else 4 * radius + 1
    met = neighbourhood(cells.select("row", "col").distinct(), radius, cross).groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n"))
    return met.filter(F.col("_n") == size).select("row", "col")


def closing(cells: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(cells, radius), radius)


def median3(cells: DataFrame) -> DataFrame:
    """Cells with at least five of the nine cells around them set."""
    met = neighbourhood(cells.select("row", "col").distinct()).groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n"))
    return met.filter("_n >= 5").select("row", "col")


def clean_masks(free: DataFrame, occupied: DataFrame, footprint: DataFrame, radius: int = 1, blur: bool = True) -> tuple[DataFrame, DataFrame]:
    """(free, occupied): free closed and blurred, occupied widened, the robot's footprint free."""
    closed = closing(free, radius)
    closed = median3(closed) if blur else closed
    wide = dilate(occupied, radius).join(footprint.select("row", "col").distinct(), ["row", "col"], "left_anti")
    open_cells = closed.unionByName(footprint.select("row", "col")).distinct().join(wide, ["row", "col"], "left_anti")
    return open_cells, wide


def frontiers(free: DataFrame, occupied: DataFrame, unexplored: DataFrame) -> DataFrame:
    """Cells that are neither near the unexplored nor occupied nor free, as a set: |1 - (widened unexplored or occupied) - free|."""
    every = free.unionByName(occupied).unionByName(unexplored).select("row", "col").distinct()
    hidden = dilate(unexplored).unionByName(occupied.select("row", "col")).distinct().withColumn("_h", F.lit(1))
    marked = every.join(hidden, ["row", "col"], "left").join(free.select("row", "col").distinct().withColumn("_f", F.lit(1)), ["row", "col"], "left")
    value = F.abs(F.lit(1) - F.coalesce("_h", F.lit(0)) - F.coalesce("_f", F.lit(0)))
    return marked.filter(value == 1).select("row", "col")


def frame_mask(lines: DataFrame, rows: int, cols: int, x0: float, y0: float, step: float) -> DataFrame:
    """Cells inside at least one scan polygon (obj_id is the frame)."""
    from orbweave.operators.surface import grid_points, points_in_polygons

    g = grid_points(lines, rows, cols, x0, y0, step)
    return points_in_polygons(g, "id", lines).select("id").distinct().join(g, "id").select("row", "col")


def coverage(map_free: DataFrame, scanned: DataFrame) -> DataFrame:
    """Free cells of a map, those scanned, and their ratio."""
    both = map_free.select("row", "col").distinct().join(scanned.select("row", "col").distinct().withColumn("_s", F.lit(1)), ["row", "col"], "left")
    out = both.agg(F.count(F.lit(1)).alias("free"), F.coalesce(F.sum("_s"), F.lit(0)).alias("scanned"))
    return out.withColumn("ratio", F.when(F.col("free") > 0, F.col("scanned") / F.col("free")))


def verified(covered: DataFrame, least: float = 0.97) -> DataFrame:
    """coverage() with verified: whether enough of the map was scanned."""
    return covered.withColumn("verified", F.coalesce(F.col("ratio") >= least, F.lit(False)))


def ray_infos(rays: DataFrame, low: list[float], high: list[float], density: float, max_range: float) -> DataFrame:
    """Rays (origin x, y[, z], end ex, ey[, ez]) with hit, n_free and the part [r1, r2] that lies in the map's box; others are left out."""
    axes = [a for a in ("x", "y", "z") if a in rays.columns]
    d = [F.col(f"e{a}") - F.col(a) for a in axes]
    length = norm(d)
    ok, near, far = ray_box(axes, d, [F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high])
    r1, r2 = F.greatest(near, F.lit(0.0)), F.least(far, F.lit(1.0))
    inside = F.lit(True)
    for a, lo, hi in zip(axes, low, high, strict=True):
        inside = inside & F.col(f"e{a}").between(lo, hi)
    marked = rays.select("*", length.alias("length"), ok.alias("_ok"), r1.alias("r1"), r2.alias("r2"), (inside & (length <= max_range)).alias("hit"))
    kept = marked.filter("_ok and r1 < r2 and length > 0").drop("_ok")
    return kept.withColumn("n_free", F.ceil((F.col("r2") - F.col("r1")) * F.col("length") * density).cast("int"))


def training_set(infos: DataFrame, ray_id: str, seed: int = 0, most: int | None = None) -> DataFrame:
    """ray_id, position, label: a hit's end (1) and n_free points before it (0); `most` keeps that many by equal share of every ray."""
    axes = [a for a in ("x", "y", "z") if a in infos.columns]
    hits = infos.filter("hit").select(ray_id, *[F.col(f"e{a}").alias(f"s{a}") for a in axes], F.lit(1).alias("label"))
    drawn = infos.filter("n_free > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n_free"))).alias("_i")).withColumn("_t", F.col("r1") + (F.col("r2") - F.col("r1")) * F.rand(seed))
    free = drawn.select(ray_id, *[(F.col(a) + (F.col(f"e{a}") - F.col(a)) * F.col("_t")).alias(f"s{a}") for a in axes], F.lit(0).alias("label"))
    every = hits.unionByName(free)
    if most is None:
        return every
    n = every.count()
    return every if n <= most else every.filter(F.rand(seed + 1) < most / n)
