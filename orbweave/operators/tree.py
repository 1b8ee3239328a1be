"""Quadtrees and octrees as leaf tables: build, update, structure, lookup.

A tree is a table of leaves (d, kx, ky[, kz], log_odds): the depth, the key of the block at that depth, and a value. Inner
nodes are derived by grouping. Tables may be partitioned by a Morton tile, after which updates and roll-ups below the tile
need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.keys import TreeSetting, at_depth, centre, checked_key, in_tree, morton, node_size, prefix, tile
from orbweave.operators.fold import clamp, fold
from orbweave.operators.rays import crossed_cells, ray_cells, search_cells


#: Leaves in a group of a kernel, about.
GROUP = 1 << 20


def axes_of(df: DataFrame) -> list[str]:
    return [k for k in ("kx", "ky", "kz") if k in df.columns]


# inserting


def gate(points: DataFrame, coords: list[str], origin: list[str], min_range: float = 0.0, max_range: float = -1.0, box: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Points that count as hits: farther than min_range, within max_range (not positive: no limit) and the box. Adds range."""
    r = F.sqrt(sum(((F.col(c) - F.col(o)) ** 2 for c, o in zip(coords, origin, strict=True)), F.lit(0.0)))
    out = points.withColumn("range", r).filter(F.col("range") > min_range)
    if max_range > 0:
        out = out.filter(F.col("range") <= max_range)
    for i, c in enumerate(coords if box else []):
        out = out.filter((F.col(c) >= box[0][i]) & (F.col(c) <= box[1][i]))
    return out


def end_keys(points: DataFrame, coords: list[str], s: TreeSetting) -> DataFrame:
    """All columns of points with their keys; points beyond the tree are left out."""
    names = ["kx", "ky", "kz"][: len(coords)]
    out = points.select("*", *[checked_key(c, s).alias(k) for c, k in zip(coords, names, strict=True)])
    for k in names:
        out = out.filter(F.col(k).isNotNull())
    return out


def points_by_cell(points: DataFrame, coords: list[str], s: TreeSetting, by: list[str], index: str) -> DataFrame:
    """Cells with the indices of their points in order."""
    names = ["kx", "ky", "kz"][: len(coords)]
    return end_keys(points, coords, s).groupBy(*by, *names).agg(F.array_sort(F.collect_list(index)).alias("points"))


def first_points(points: DataFrame, coords: list[str], s: TreeSetting, frame: str, index: str) -> DataFrame:
    """Of the points of a frame in one cell, the first."""
    names = ["kx", "ky", "kz"][: len(coords)]
    rest = [c for c in points.columns if c not in (frame, index)]
    keyed = end_keys(points, coords, s)
    return keyed.groupBy(frame, *names).agg(F.min(F.struct(index, *rest)).alias("_p")).select(frame, f"_p.{index}", *[f"_p.{c}" for c in rest])


def scan_updates(points: DataFrame, coords: list[str], origin: list[str], s: TreeSetting, frame: str = "frame", index: str = "pt_idx", min_range: float = 0.0, max_range: float = -1.0, discretise: bool = False, box: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """frame, keys, occupied: what each frame says of each cell, once. A cell that is both hit and crossed is hit.

    frame is a whole number. Rays are cut at max_range. Cells are made distinct where rays are; hits and crossings are one grouping by (frame, cell) with partial aggregation, which does what a
    distinct and an anti join would do in three shuffles.
    """
    names = ["kx", "ky", "kz"][: len(coords)]
    if discretise:
        points = first_points(points, coords, s, frame, index)
    hits = end_keys(gate(points, coords, origin, min_range, max_range, box), coords, s).select(frame, *names, F.lit(1).alias("hit"))
    cut = points.withColumn("_r", F.sqrt(sum(((F.col(c) - F.col(o)) ** 2 for c, o in zip(coords, origin, strict=True)), F.lit(0.0))))
    scale = F.least(F.lit(1.0), F.lit(float(max_range)) / F.when(F.col("_r") > 0, F.col("_r"))) if max_range > 0 else F.lit(1.0)
    ends = cut.select(frame, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(origin)], *[(F.col(o) + (F.col(c) - F.col(o)) * F.coalesce(scale, F.lit(1.0))).alias(f"_c{i}") for i, (c, o) in enumerate(zip(coords, origin, strict=True))])
    crossed = crossed_cells(ends, frame, [f"_o{i}" for i in range(len(coords))], [f"_c{i}" for i in range(len(coords))], s).select(frame, *names, F.lit(0).alias("hit"))
    return hits.unionByName(crossed).groupBy(frame, *names).agg((F.max("hit") == 1).alias("occupied"))


def insert_scans(points: DataFrame, coords: list[str], origin: list[str], s: TreeSetting, frame: str = "frame", tree: DataFrame | None = None, **how: object) -> DataFrame:
    """The tree's full-depth leaves after all frames in order: each updates a cell once."""
    updates = scan_updates(points, coords, origin, s, frame, **how)
    delta = F.when(F.col("occupied"), F.lit(s.log_odds_hit)).otherwise(F.lit(s.log_odds_miss))
    return update_cells(updates.withColumn("delta", delta), s, [frame], tree)


def insert_rays(points: DataFrame, coords: list[str], origin: list[str], s: TreeSetting, frame: str = "frame", index: str = "pt_idx", min_range: float = 0.0, max_range: float = -1.0, crop: bool = False, tree: DataFrame | None = None) -> DataFrame:
    """Every ray updates every cell that it crosses, in order of points, then its end; crop: rays end at max_range."""
    names = ["kx", "ky", "kz"][: len(coords)]
    ranged = points.withColumn("_r", F.sqrt(sum(((F.col(c) - F.col(o)) ** 2 for c, o in zip(coords, origin, strict=True)), F.lit(0.0))))
    scale = F.coalesce(F.least(F.lit(1.0), F.lit(float(max_range)) / F.when(F.col("_r") > 0, F.col("_r"))), F.lit(1.0)) if crop and max_range > 0 else F.lit(1.0)
    ends = ranged.select(frame, index, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(origin)], *[(F.col(o) + (F.col(c) - F.col(o)) * scale).alias(f"_c{i}") for i, (c, o) in enumerate(zip(coords, origin, strict=True))])
    free = ray_cells(ends, [f"_o{i}" for i in range(len(coords))], [f"_c{i}" for i in range(len(coords))], s).select(frame, index, "step", *names, F.lit(s.log_odds_miss).alias("delta"))
    hits = end_keys(gate(points, coords, origin, min_range, max_range), coords, s).select(frame, index, F.lit(1 << 30).alias("step"), *names, F.lit(s.log_odds_hit).alias("delta"))
    return update_cells(free.unionByName(hits), s, [frame, index, "step"], tree)


def update_cells(updates: DataFrame, s: TreeSetting, order: list[str], tree: DataFrame | None = None) -> DataFrame:
    """Leaves after ordered updates (keys, delta). Updated cells of coarser leaves are split off first."""
    names = axes_of(updates)
    start = None
    if tree is not None:
        tree = split_leaves(tree, updates.select(*names).distinct(), s)
        start = tree.filter(F.col("d") == s.depth).select(*names, "log_odds")
    folded = fold(updates, names, order, s, start=start).select(F.lit(s.depth).alias("d"), *names, "log_odds")
    if tree is None:
        return folded
    return folded.unionByName(tree.filter(F.col("d") < s.depth).select("d", *names, "log_odds"))


def split_leaves(tree: DataFrame, cells: DataFrame, s: TreeSetting, to: int | None = None) -> DataFrame:
    """The tree with every leaf above depth `to` (full by default) that covers one of the cells split until the cell's block is a leaf.

    No loop over levels: a split leaf's inner nodes are the ancestors of the cells below it, and its new leaves are those
    nodes' children that are no inner nodes themselves.
    """
    names = axes_of(tree)
    n, to = len(names), s.depth if to is None else to
    on = [f"_p{i}" for i in range(n)]
    tree = tree.select("d", *names, "log_odds")
    covered = search_cells(cells.select(*names).distinct(), tree, s, names).filter(F.col("d") < to)
    gone = covered.select(F.col("d").alias("_d"), *[prefix(k, F.col("d"), s).alias(p) for k, p in zip(names, on, strict=True)]).distinct()
    kept = tree.select("*", F.col("d").alias("_d"), *[prefix(k, F.col("d"), s).alias(p) for k, p in zip(names, on, strict=True)]).join(gone, ["_d", *on], "left_anti").select("d", *names, "log_odds")
    inner = covered.select("log_odds", *names, F.explode(F.sequence(F.col("d"), F.lit(to - 1))).alias("_d"))
    inner = inner.select("log_odds", "_d", *[prefix(k, F.col("_d"), s).alias(p) for k, p in zip(names, on, strict=True)]).distinct()
    made = inner.select("log_odds", (F.col("_d") + 1).alias("_d"), *on, F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("_i"))
    made = made.select("log_odds", "_d", *[(F.col(p) * 2 + F.shiftright("_i", i).bitwiseAND(F.lit(1))).cast("int").alias(p) for i, p in enumerate(on)])
    made = made.join(inner.select("_d", *on), ["_d", *on], "left_anti")
    width = F.pow(F.lit(2.0), F.lit(s.depth) - F.col("_d"))
    new = made.select(F.col("_d").cast("int").alias("d"), *[(F.col(p) * width + F.floor(width / 2)).cast("int").alias(k) for p, k in zip(on, names, strict=True)], "log_odds")
    return kept.unionByName(new)


# structure


def children(nodes: DataFrame, s: TreeSetting) -> DataFrame:
    """The 2**axes children of each node, with its value."""
    names = axes_of(nodes)
    n = len(names)
    made = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("_i"))
    width = F.pow(F.lit(2.0), F.lit(s.depth) - F.col("d") - 1)
    first = [F.floor(prefix(k, F.col("d"), s) * 2 + F.shiftright("_i", i).bitwiseAND(F.lit(1))).cast("int") for i, k in enumerate(names)]
    keys = [(p * width + F.floor(width / 2)).cast("int").alias(k) for p, k in zip(first, names, strict=True)]
    return made.select((F.col("d") + 1).alias("d"), *keys, *[c for c in nodes.columns if c not in ("d", *names)])


def parents(nodes: DataFrame, s: TreeSetting) -> list[Column]:
    """Key of the parent on each axis."""
    return [at_depth(k, F.col("d") - 1, s).alias(k) for k in axes_of(nodes)]


def _merge_siblings(names: list[str], depth: int, bottom: int, stop: int) -> Callable[[pa.Table], pa.Table]:
    """A kernel that merges complete equal siblings among leaves from depth `bottom` up to depth `stop`."""
    n = len(names)

    def run(table: pa.Table) -> pa.Table:
        d = table.column("d").to_numpy().astype(np.int64)
        keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in names], 1)
        v = table.column("log_odds").to_numpy()
        done: list[tuple] = []
        k, x = keys[d == bottom], v[d == bottom]
        for level in range(bottom, stop, -1):
            shift = depth - level + 1
            up = k >> shift
            if len(k):
                order = np.lexsort((x, *up.T))
                k, x, up = k[order], x[order], up[order]
                starts = np.flatnonzero(np.concatenate([[True], (up[1:] != up[:-1]).any(1)]))
                counts = np.diff(np.append(starts, len(k)))
                whole = (counts == 2**n) & (x[starts] == x[starts + counts - 1])
                stays = ~np.repeat(whole, counts)
                done.append((np.full(stays.sum(), level), k[stays], x[stays]))
                k, x = (up[starts[whole]] << shift) + (1 << (shift - 1)), x[starts[whole]]
            mine = d == level - 1
            k, x = np.concatenate([k, keys[mine]]), np.concatenate([x, v[mine]])
        rest = d < stop
        done += [(np.full(len(k), stop), k, x), (d[rest], keys[rest], v[rest])]
        ds, ks, vs = (np.concatenate(c) for c in zip(*done, strict=True))
        return pa.table({"d": ds.astype(np.int32), **{c: ks[:, i].astype(np.int32) for i, c in enumerate(names)}, "log_odds": vs})

    return run


def prune(leaves: DataFrame, s: TreeSetting, lowest: int = 1, tile_depth: int | None = None) -> DataFrame:
    """Merges complete sets of sibling leaves with equal log-odds, from the bottom up; the root is never a leaf.

    Level by level, joins would be a shuffle for each of sixteen levels. A tile holds its whole subtree, so all levels below
    the tiles' depth are one shuffle by tile and a kernel on each; the tiles themselves, some thousands at most whatever the
    tree, are merged in one more group.
    """
    names = axes_of(leaves)
    n = len(names)
    at = tile_depth if tile_depth is not None else 12 // n
    at = max(lowest, min(at, s.depth - 1))
    kind = "d int, " + ", ".join(f"{k} int" for k in names) + ", log_odds double"
    rows = leaves.select(F.col("d").cast("int").alias("d"), *names, F.col("log_odds").cast("double").alias("log_odds"))
    # a group is some tiles, of GROUP leaves on average; no fewer groups than shuffles have partitions
    groups = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // GROUP))
    deep = rows.filter(F.col("d") >= at).withColumn("_tile", F.pmod(F.hash(tile(morton(names), n, at, s)), F.lit(groups)))
    below = _merge_siblings(names, s.depth, s.depth, at)
    merged = deep.groupBy("_tile").applyInArrow(lambda t: below(t.drop(["_tile"])), kind)
    marked = merged.unionByName(rows.filter(F.col("d") < at)).withColumn("_top", F.when(F.col("d") > at, 0).otherwise(-1))
    above = _merge_siblings(names, s.depth, at, lowest)
    top = marked.filter("_top = -1").groupBy("_top").applyInArrow(lambda t: above(t.drop(["_top"])), kind)
    return marked.filter("_top <> -1").select("d", *names, "log_odds").unionByName(top)


def expand(leaves: DataFrame, s: TreeSetting, to: int | None = None, most: int = 1 << 22) -> DataFrame:
    """All leaves at a depth (full by default). A leaf that would become more than `most` is refused."""
    names = axes_of(leaves)
    n, to = len(names), s.depth if to is None else to
    least = leaves.agg(F.min("d")).first()[0]
    if least is not None and 2 ** (n * max(0, to - least)) > most:
        raise ValueError(f"a leaf at depth {least} would become {2 ** (n * (to - least))}")
    side = F.pow(F.lit(2.0), F.greatest(F.lit(to) - F.col("d"), F.lit(0))).cast("int")
    count = F.pow(side.cast("double"), F.lit(n)).cast("int")
    made = leaves.select("*", side.alias("_side"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_i"))
    low = F.least(F.col("d") + 0, F.lit(to))
    width = F.pow(F.lit(2.0), F.lit(s.depth - to)).cast("int")
    keys = []
    for i, k in enumerate(names):
        at = F.floor(F.col("_i") / F.pow(F.col("_side").cast("double"), F.lit(i))).cast("int") % F.col("_side")
        deeper = (prefix(k, low, s) * F.col("_side") + at) * width + (1 << (s.depth - to) >> 1)
        keys.append(F.when(F.col("d") >= to, F.col(k)).otherwise(deeper).cast("int").alias(k))
    return made.select(F.greatest(F.col("d"), F.lit(to)).cast("int").alias("d"), *keys, *[c for c in leaves.columns if c not in ("d", *names)])


def nodes(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """All nodes from the root down: d, keys, log_odds (the largest below), mean (of the probabilities below, as log-odds), leaves, is_leaf.

    A leaf is told to each of its ancestors, and one grouping with partial aggregation rolls all levels up.
    """
    names = axes_of(leaves)
    told = leaves.select(F.col("d").alias("_leaf"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], "log_odds", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("d"))
    keyed = told.select("_leaf", "d", "log_odds", *[F.when(F.col("d") == 0, s.offset).otherwise(at_depth(f"_k{i}", F.col("d"), s)).cast("int").alias(k) for i, k in enumerate(names)])
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds")))
    out = keyed.groupBy("d", *names).agg(F.max("log_odds").alias("log_odds"), F.avg(p).alias("_p"), F.count(F.lit(1)).alias("leaves"), (F.max("_leaf") == F.col("d")).alias("is_leaf"))
    return out.select("d", *names, "log_odds", F.log(F.col("_p") / (F.lit(1.0) - F.col("_p"))).alias("mean"), "leaves", "is_leaf")


def tree_size(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """nodes, leaves: how many there are."""
    return nodes(leaves, s).agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"))


def insert_node(leaves: DataFrame, cells: DataFrame, s: TreeSetting) -> DataFrame:
    """Leaves with empty nodes (d and keys, value 0) added where there are none."""
    names = axes_of(leaves)
    there = search_cells(cells.select("d", *names).withColumnRenamed("d", "_at"), leaves, s).filter(F.col("d").isNull() | (F.col("d") > F.col("_at")))
    return leaves.unionByName(there.select(F.col("_at").alias("d"), *[at_depth(k, F.col("_at"), s).alias(k) for k in names], F.lit(0.0).alias("log_odds")))


def delete_block(leaves: DataFrame, keys: list[int], d: int, s: TreeSetting) -> DataFrame:
    """Leaves without the block at depth d that holds a key; a coarser leaf that covers it is split first."""
    names = axes_of(leaves)
    cell = leaves.sparkSession.range(1).select(*[F.lit(int(v)).alias(k) for k, v in zip(names, keys, strict=True)])
    inside = F.col("d") >= d
    for k, v in zip(names, keys, strict=True):
        inside = inside & (prefix(k, d, s) == (v >> (s.depth - d)))
    return split_leaves(leaves, cell, s, d).filter(~inside)


def same_tree(a: DataFrame, b: DataFrame) -> bool:
    columns = ["d", *axes_of(a), "log_odds"]
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def occupied(s: TreeSetting) -> Column:
    return F.col("log_odds") >= s.threshold


def saturated(s: TreeSetting) -> Column:
    return (F.col("log_odds") >= s.log_odds_max) | (F.col("log_odds") <= s.log_odds_min)


def most_likely(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """Every leaf at the greatest or least log-odds."""
    return leaves.withColumn("log_odds", F.when(occupied(s), F.lit(s.log_odds_max)).otherwise(F.lit(s.log_odds_min)))


def changes(before: DataFrame, after: DataFrame, s: TreeSetting) -> DataFrame:
    """keys, is_new: cells that are new, or whose state is another."""
    names = axes_of(after)
    a = before.select(*names, occupied(s).alias("_was"))
    b = after.select(*names, occupied(s).alias("_is"))
    return b.join(a, names, "left").filter("_was is null or _was <> _is").select(*names, F.col("_was").isNull().alias("is_new"))


def bounds(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """Least and greatest coordinate of all leaves on each axis."""
    out = []
    for k in axes_of(leaves):
        half = node_size(F.col("d"), s) / 2
        out += [F.min(centre(k, s, F.col("d")) - half).alias(f"min_{k[1]}"), F.max(centre(k, s, F.col("d")) + half).alias(f"max_{k[1]}")]
    return leaves.agg(*out)


def leaf_boxes(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """Leaves with the corners of their boxes: what a drawing needs."""
    out = []
    for k in axes_of(leaves):
        half = node_size(F.col("d"), s) / 2
        out += [(centre(k, s, F.col("d")) - half).alias(f"min_{k[1]}"), (centre(k, s, F.col("d")) + half).alias(f"max_{k[1]}")]
    return leaves.select("*", *out)


def sample_free(leaves: DataFrame, n: int, s: TreeSetting, seed: int = 0) -> DataFrame:
    """About n positions, uniform over the area that is known and not occupied."""
    names = axes_of(leaves)
    free = leaves.filter(~occupied(s))
    area = F.pow(node_size(F.col("d"), s), F.lit(len(names)))
    total = free.agg(F.sum(area)).first()[0]
    if not total:
        return free.select(*[F.lit(0.0).alias(k[1]) for k in names]).limit(0)
    want = area / F.lit(float(total)) * n
    count = (F.floor(want) + (F.rand(seed) < want - F.floor(want)).cast("int")).cast("int")
    drawn = free.withColumn("_n", count).filter("_n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    return drawn.select(*[(centre(k, s, F.col("d")) + (F.rand(seed + 1 + i) - 0.5) * node_size(F.col("d"), s)).alias(k[1]) for i, k in enumerate(names)])


# lookup


def search(cells: DataFrame, leaves: DataFrame, s: TreeSetting) -> DataFrame:
    return search_cells(cells, leaves, s)


def search_path(cells: DataFrame, leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """Every node from the root to the leaf that covers a cell."""
    names = axes_of(cells)
    every = nodes(leaves, s).select("d", *[prefix(k, F.col("d"), s).alias(f"_p{i}") for i, k in enumerate(names)], "log_odds", "is_leaf")
    asked = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.depth))).alias("d"))
    asked = asked.select("*", *[prefix(k, F.col("d"), s).alias(f"_p{i}") for i, k in enumerate(names)])
    return asked.join(every, ["d", *[f"_p{i}" for i in range(len(names))]]).select(*cells.columns, "d", "log_odds", "is_leaf")


def walk(leaves: DataFrame, s: TreeSetting, max_depth: int | None = None) -> DataFrame:
    """Nodes with their place in a depth-first walk: by the Morton code of the first cell, then depth."""
    names = axes_of(leaves)
    every = nodes(leaves, s)
    if max_depth is not None:
        every = every.filter(F.col("d") <= max_depth)
    low = [(prefix(k, F.col("d"), s) * F.pow(F.lit(2.0), F.lit(s.depth) - F.col("d"))).cast("int") for k in names]
    return every.withColumn("first_cell", morton(low)).orderBy("first_cell", "d")


def leaves_below(leaves: DataFrame, keys: list[int], d: int, s: TreeSetting) -> DataFrame:
    out = leaves.filter(F.col("d") >= d)
    for k, v in zip(axes_of(leaves), keys, strict=True):
        out = out.filter(prefix(k, d, s) == (v >> (s.depth - d)))
    return out


def leaves_in_box(leaves: DataFrame, low: list[float], high: list[float], s: TreeSetting) -> DataFrame:
    """Leaves that overlap a box; its range of keys is a plain filter, pushed to files sorted by key."""
    out = leaves
    for k, a, b in zip(axes_of(leaves), low, high, strict=True):
        half = node_size(F.col("d"), s) / 2
        out = out.filter((centre(k, s, F.col("d")) - half < b) & (centre(k, s, F.col("d")) + half > a))
    return out


def leaf_neighbours(leaves: DataFrame, s: TreeSetting, axis: int, side: int) -> DataFrame:
    """Pairs of leaves (a's and b's d and keys) that touch on a's face of an axis (side -1 or 1), of any sizes.

    The smaller leaf of a pair asks for the block beyond its face at each depth that leaves have: an equi-join.
    """
    names = axes_of(leaves)

    def meet(step: int) -> DataFrame:
        """(small leaf, leaf of its size or larger beyond its face in direction step)."""
        width = F.pow(F.lit(2.0), F.lit(s.depth) - F.col("d")).cast("int")
        low = prefix(names[axis], F.col("d"), s) * width
        beyond = low - 1 if step < 0 else low + width
        cells = leaves.select(F.col("d").alias("_d"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], *[(beyond if i == axis else F.col(k)).cast("int").alias(k) for i, k in enumerate(names)])
        cells = cells.filter(in_tree(names[axis], s))
        depths = sorted(r[0] for r in leaves.select("d").distinct().collect())
        asked = cells.select("*", F.explode(F.array(*map(F.lit, depths))).alias("_at")).filter("_at <= _d")
        asked = asked.select("_d", *[f"_k{i}" for i in range(len(names))], "_at", *[prefix(k, F.col("_at"), s).alias(f"_p{i}") for i, k in enumerate(names)])
        known = leaves.select(F.col("d").alias("_at"), *[F.col(k).alias(f"_q{i}") for i, k in enumerate(names)], *[prefix(k, F.col("d"), s).alias(f"_p{i}") for i, k in enumerate(names)])
        return asked.join(known, ["_at", *[f"_p{i}" for i in range(len(names))]])

    here, there = [f"_k{i}" for i in range(len(names))], [f"_q{i}" for i in range(len(names))]
    label = lambda d, ks, n: [F.col(d).alias(f"{n}_d"), *[F.col(c).alias(f"{n}_{k}") for c, k in zip(ks, names, strict=True)]]
    a_small = meet(side).select(*label("_d", here, "a"), *label("_at", there, "b"))
    b_small = meet(-side).filter("_at < _d").select(*label("_at", there, "a"), *label("_d", here, "b"))
    return a_small.unionByName(b_small)


def image_to_tree(pixels: DataFrame, s: TreeSetting, threshold: float, padding: int = 0) -> DataFrame:
    """Full-depth leaves of an image (row, col, value): one update a pixel, occupied above the threshold, in an occupied ring.

    Pixel (row, col) is the cell (col, row) of the tree's positive quarter.
    """
    sized = pixels.agg(F.max("row").alias("h"), F.max("col").alias("w"))
    cells = pixels.select((F.col("col") + s.offset).cast("int").alias("kx"), (F.col("row") + s.offset).cast("int").alias("ky"), (F.col("value") >= threshold).alias("hit"))
    if padding > 0:
        ring = sized.select("h", "w", F.explode(F.sequence(F.lit(-padding), F.col("h") + padding)).alias("row")).select("h", "w", "row", F.explode(F.sequence(F.lit(-padding), F.col("w") + padding)).alias("col"))
        ring = ring.filter((F.col("row") < 0) | (F.col("row") > F.col("h")) | (F.col("col") < 0) | (F.col("col") > F.col("w")))
        cells = cells.unionByName(ring.select((F.col("col") + s.offset).cast("int").alias("kx"), (F.col("row") + s.offset).cast("int").alias("ky"), F.lit(True).alias("hit")))
    value = clamp(F.when(F.col("hit"), F.lit(s.log_odds_hit)).otherwise(F.lit(s.log_odds_miss)), s.log_odds_min, s.log_odds_max)
    return cells.select(F.lit(s.depth).alias("d"), "kx", "ky", value.alias("log_odds"))


def compact(leaves: DataFrame, s: TreeSetting) -> DataFrame:
    """d, morton, occupied: the lossy form of a tree. The tree itself isn't changed."""
    return leaves.select("d", morton(axes_of(leaves)).alias("morton"), occupied(s).alias("occupied"))


def deepest_only(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("d").desc()))).filter("_r = 1").drop("_r")
