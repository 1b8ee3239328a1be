"""Cell keys of quadtrees and octrees as Column expressions.

A tree of depth D has 2**D cells of width `resolution` on each axis; the cell of the origin has key 2**(D-1). A key at
depth d names the block of 2**(D-d) cells that holds it by the key of its middle. Everything here is integer
arithmetic on columns, the same in two and three dimensions, and stays in generated code.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TreeSetting:
    """The setting of a tree; the defaults are the usual ones of log-odds maps."""

    resolution: float = 0.1
    depth: int = 16
    log_odds_min: float = -2.0
    log_odds_max: float = 3.5
    log_odds_hit: float = 0.85
    log_odds_miss: float = -0.4
    threshold: float = 0.0

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= 16:
            raise ValueError("a tree has 1 to 16 levels")
        if self.resolution <= 0:
            raise ValueError("the resolution must be positive")

    @property
    def offset(self) -> int:
        return 1 << (self.depth - 1)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> TreeSetting:
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(self.to_dict().values())], list(self.to_dict()))

    @classmethod
    def from_frame(cls, df: DataFrame) -> TreeSetting:
        return cls.from_dict(df.first().asDict())


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str, s: TreeSetting) -> Column:
    """Key of a coordinate; beyond the tree it is out of [0, 2**depth)."""
    return (F.floor(_c(c) / F.lit(float(s.resolution))) + s.offset).cast("int")


def in_tree(k: Column | str, s: TreeSetting) -> Column:
    return (_c(k) >= 0) & (_c(k) < 2 * s.offset)


def checked_key(c: Column | str, s: TreeSetting) -> Column:
    """Key of a coordinate; null outside the tree, for infinities, NaN and null."""
    cells = _c(c) / F.lit(float(s.resolution))
    inside = (cells >= F.lit(float(-s.offset))) & (cells < F.lit(float(s.offset))) & ~F.isnan(cells)
    return F.when(inside, (F.floor(cells) + s.offset).cast("int"))


def at_depth(k: Column | str, d: Column | int, s: TreeSetting) -> Column:
    """Key at depth d of a key at full depth."""
    d = d if isinstance(d, Column) else F.lit(d)
    width = F.pow(F.lit(2), F.lit(s.depth) - d).cast("int")
    return F.when(d == s.depth, _c(k)).otherwise((_c(k) - F.pmod(_c(k), width) + F.floor(width / 2)).cast("int"))


def centre(k: Column | str, s: TreeSetting, d: Column | int | None = None) -> Column:
    """Centre of a cell, or of its block at depth d; the root's is 0."""
    if d is None:
        return (_c(k) - s.offset + F.lit(0.5)) * F.lit(float(s.resolution))
    d = d if isinstance(d, Column) else F.lit(d)
    width = F.pow(F.lit(2.0), F.lit(s.depth) - d)
    return F.when(d == 0, F.lit(0.0)).otherwise((F.floor((_c(k) - s.offset) / width) + F.lit(0.5)) * F.lit(float(s.resolution)) * width)


def vertex(k: Column | str, s: TreeSetting, d: Column | int | None = None) -> Column:
    """Least corner of a cell, or of its block at depth d."""
    if d is None:
        return (_c(k) - s.offset) * F.lit(float(s.resolution))
    return centre(k, s, d) - node_size(d, s) / 2


def node_size(d: Column | int, s: TreeSetting) -> Column:
    d = d if isinstance(d, Column) else F.lit(d)
    return F.lit(float(s.resolution)) * F.pow(F.lit(2.0), F.lit(s.depth) - d)


def prefix(k: Column | str, d: Column | int, s: TreeSetting) -> Column:
    """Number of the block at depth d that holds key k: what blocks are joined on."""
    d = d if isinstance(d, Column) else F.lit(d)
    return F.floor(_c(k) / F.pow(F.lit(2.0), F.lit(s.depth) - d)).cast("int")


def child_index(keys: list[Column | str], level: Column | int) -> Column:
    """Which child a key falls in: bit i is the i-th axis's bit of the level (0 is the deepest)."""
    level = level if isinstance(level, Column) else F.lit(level)
    bit = lambda k: F.pmod(F.floor(_c(k) / F.pow(F.lit(2.0), level)).cast("int"), F.lit(2))
    out = bit(keys[0])
    for i, k in enumerate(keys[1:], 1):
        out = out + bit(k) * (1 << i)
    return out.cast("int")


def child_key(k: Column | str, bit: Column | int, d: Column | int, s: TreeSetting) -> Column:
    """Key on one axis of a child (its bit on that axis) of a node at depth d."""
    d = d if isinstance(d, Column) else F.lit(d)
    bit = bit if isinstance(bit, Column) else F.lit(bit)
    quarter = F.floor(F.pow(F.lit(2.0), F.lit(s.depth) - d - 2)).cast("int")
    last = d == s.depth - 1
    return F.when(last, _c(k) - 1 + bit).otherwise(F.when(bit == 1, _c(k) + quarter).otherwise(_c(k) - quarter)).cast("int")


def neighbour(k: Column | str, step: int, d: Column | int, s: TreeSetting) -> Column:
    """Key of the next block at depth d in a direction (+1 or -1), null beyond the tree."""
    d = d if isinstance(d, Column) else F.lit(d)
    moved = _c(k) + step * F.pow(F.lit(2.0), F.lit(s.depth) - d).cast("int")
    return F.when(in_tree(moved, s), moved)


def common_ancestor_depth(a: list[Column | str], b: list[Column | str], s: TreeSetting) -> Column:
    """Depth of the deepest block that holds both keys: by the highest bit in which they differ."""
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        differ = differ.bitwiseOR(_c(x).bitwiseXOR(_c(y)))
    return F.when(differ == 0, s.depth).otherwise(F.lit(s.depth) - F.length(F.bin(differ.cast("long")))).cast("int")


def common_ancestor(a: list[Column | str], b: list[Column | str], s: TreeSetting) -> list[Column]:
    """Key on each axis of the deepest block that holds both keys."""
    d = common_ancestor_depth(a, b, s)
    return [F.when(d == 0, s.offset).otherwise(at_depth(k, d, s)).cast("int") for k in a]


def _spread(k: Column, steps: list[tuple[int, int]]) -> Column:
    k = k.cast("long")
    for shift, mask in steps:
        k = k.bitwiseOR(F.shiftleft(k, shift)).bitwiseAND(F.lit(mask))
    return k


def _gather(m: Column, steps: list[tuple[int, int]]) -> Column:
    for shift, mask in steps:
        m = m.bitwiseOR(F.shiftright(m, shift)).bitwiseAND(F.lit(mask))
    return m.cast("int")


def _masks(axes: int) -> list[int]:
    """Masks that keep runs of 16, 8, 4, 2 and 1 bits, spread `axes` times as far."""
    return [sum(((1 << run) - 1) << (axes * run * i) for i in range(16 // run)) for run in (8, 4, 2, 1)]


def morton(keys: list[Column | str]) -> Column:
    """Interleaves the bits of two or three keys."""
    n = len(keys)
    steps = [((n - 1) * run, mask) for run, mask in zip((8, 4, 2, 1), _masks(n), strict=True)]
    out = _spread(_c(keys[0]), steps)
    for i, k in enumerate(keys[1:], 1):
        out = out.bitwiseOR(F.shiftleft(_spread(_c(k), steps), i))
    return out


def unmorton(code: Column | str, axes: int) -> list[Column]:
    """The keys of a Morton code."""
    masks = _masks(axes)
    steps = [((axes - 1) * run, mask) for run, mask in zip((1, 2, 4, 8), [*masks[-2::-1], 0xFFFF], strict=True)]
    return [_gather(F.shiftright(_c(code), i).bitwiseAND(F.lit(masks[-1])), steps) for i in range(axes)]


def tile(code: Column | str, axes: int, depth: int, s: TreeSetting) -> Column:
    """The block at a depth that a Morton code lies in: what cells are partitioned by."""
    return F.shiftright(_c(code), axes * (s.depth - depth))


def key_in_box(keys: list[Column | str], low: list[Column | str], high: list[Column | str], d: Column | int, s: TreeSetting) -> Column:
    """Whether a block at depth d overlaps the cells from low to high, both included."""
    d = d if isinstance(d, Column) else F.lit(d)
    out = F.lit(True)
    for k, a, b in zip(keys, low, high, strict=True):
        p = prefix(k, d, s)
        out = out & (p >= prefix(a, d, s)) & (p <= prefix(b, d, s))
    return out


def key_text(keys: list[Column | str]) -> Column:
    return F.concat_ws(",", *[_c(k).cast("string") for k in keys])
