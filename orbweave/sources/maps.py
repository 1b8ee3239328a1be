"""Readers and writers of map files: room polygons, street grids, scenarios, trajectories, point files and trees."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import norm, quaternion_matrix
from orbweave.functions.keys import TreeSetting, morton, tile, unmorton
from orbweave.operators.tree import axes_of, nodes

ROOM = "id string, bbox struct<min: array<double>, max: array<double>>, verts array<array<double>>"
SCENE = "bucket int, map string, map_width int, map_height int, start_x int, start_y int, goal_x int, goal_y int, optimal_length double"


def read_rooms(spark: SparkSession, path: str) -> DataFrame:
    """Room files: id, bbox, verts and the file's name."""
    return spark.read.schema(ROOM).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def room_vertices(rooms: DataFrame) -> DataFrame:
    """id, vid, x, y of rooms' polygons."""
    return rooms.select("id", F.posexplode("verts").alias("vid", "v")).select("id", "vid", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"))


def write_rooms(rooms: DataFrame, path: str) -> None:
    rooms.select("id", "bbox", "verts").write.mode("overwrite").json(path)


def room_size_statistics(rooms: DataFrame, width: float = 100.0) -> DataFrame:
    """bucket, count, ids: how many rooms have a box of each size, in steps of `width`."""
    area = (F.element_at("bbox.max", 1) - F.element_at("bbox.min", 1)) * (F.element_at("bbox.max", 2) - F.element_at("bbox.min", 2))
    return rooms.groupBy((F.floor(area / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy("bucket")


def thicken_walls(free: DataFrame, cells: int) -> DataFrame:
    """Free cells (row, col) of a room whose walls grow by a number of cells."""
    from orbweave.operators.gridmap import erode

    return erode(free, cells)


#: Characters of street maps that can be walked on.
PASSABLE = (".", "G")


def read_street_map(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, passable of street maps: four lines of header with height and width, then a line of characters a row. What lies beyond them isn't read."""
    lines = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    size = lambda name: F.regexp_extract("value", rf"(?m)^{name}\s+(\d+)", 1).cast("int")
    rows = lines.select("file", size("height").alias("height"), size("width").alias("width"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line")).filter("row >= 4 and row < height + 4")
    cells = rows.select("file", "width", (F.col("row") - 4).alias("row"), F.posexplode(F.split("line", "")).alias("col", "c")).filter("c <> '' and col < width")
    return cells.select("file", "row", "col", F.col("c").isin(*PASSABLE).alias("passable"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files: tab-separated rows after a line with the version."""
    fields = F.split("value", "\\s+")
    names = [f.split() for f in SCENE.split(", ")]
    rows = spark.read.text(path).filter(~F.col("value").startswith("version") & (F.size(F.split(F.trim("value"), "\\s+")) == len(names)))
    return rows.select(*[F.element_at(fields, i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def _numbered(df: DataFrame) -> DataFrame:
    """df, read from files, with file and frame_id: the row's number in its file, from 0, over any number of splits.

    A split's rows are consecutive in one task, so their number within it is a difference of ids; only the splits' counts are added up.
    """
    at = df.withColumns({"file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "_split": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    splits = at.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_split", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return at.join(splits, ["file", "_split"]).withColumn("frame_id", F.col("_before") + F.col("_id") - F.col("_first")).drop("_split", "_id", "_first", "_before")


def read_trajectory(spark: SparkSession, path: str, kind: str, sep: str = ",") -> DataFrame:
    """file, frame_id and pose. kind: 2d (x, y), 3d (x, y, z), se2 (x, y, theta), se3 (x, y, z, qx, qy, qz, qw), matrix (16 numbers, row by row).

    Numbers of frames follow the lines of a file.
    """
    columns = {"2d": ["tx", "ty"], "3d": ["tx", "ty", "tz"], "se2": ["tx", "ty", "theta"], "se3": ["tx", "ty", "tz", "qx", "qy", "qz", "qw"], "matrix": [f"m{i}" for i in range(16)]}[kind]
    return _numbered(spark.read.option("sep", sep).option("comment", "#").schema(", ".join(f"{c} double" for c in columns)).csv(path)).select("file", "frame_id", *columns)


def pose_matrix(poses: DataFrame, kind: str) -> DataFrame:
    """frame_id, m: 4 x 4 poses, row by row."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if kind == "se2":
        c, s = F.cos("theta"), F.sin("theta")
        m = F.array(c, -s, zero, F.col("tx"), s, c, zero, F.col("ty"), zero, zero, one, zero, zero, zero, zero, one)
    elif kind == "se3":
        size = norm(["qx", "qy", "qz", "qw"])
        r = quaternion_matrix([F.col(q) / size for q in ("qx", "qy", "qz", "qw")])
        m = F.array(*[x for row, t in zip(r, ("tx", "ty", "tz"), strict=True) for x in (*row, F.col(t))], zero, zero, zero, one)
    else:
        m = F.array(*[F.col(f"m{i}") for i in range(16)])
    return poses.select("frame_id", m.alias("m"))


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def decode_ply(data: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    """(vertex columns, faces) of an ASCII or little-endian PLY file."""
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    kinds = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
    elements: list[tuple[str, int, list]] = []
    binary = b"binary_little_endian" in head
    for line in head.decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[1:-1]))
    vertices: dict[str, np.ndarray] = {}
    faces: list[list[int]] = []
    words, at = (None if binary else body.split()), 0
    for name, n, props in elements:
        if name == "vertex":
            if binary:
                kind = np.dtype([(p, kinds[k[0]]) for p, k in props])
                rows = np.frombuffer(body, kind, n, at)
                at += n * kind.itemsize
                vertices = {p: rows[p].astype(float) for p, _ in props}
            else:
                rows = np.array(words[at : at + n * len(props)], float).reshape(n, len(props))
                at += n * len(props)
                vertices = {p: rows[:, i] for i, (p, _) in enumerate(props)}
            continue
        for _ in range(n):
            for _, k in props:
                if k[0] == "list":
                    if binary:
                        count = int(np.frombuffer(body, kinds[k[1]], 1, at)[0])
                        at += np.dtype(kinds[k[1]]).itemsize
                        values = np.frombuffer(body, kinds[k[2]], count, at).tolist()
                        at += count * np.dtype(kinds[k[2]]).itemsize
                    else:
                        count = int(words[at])
                        values = [int(x) for x in words[at + 1 : at + 1 + count]]
                        at += 1 + count
                    if name == "face":
                        faces.append(values)
                else:
                    at += np.dtype(kinds[k[0]]).itemsize if binary else 1
    return vertices, faces


def read_ply_vertices(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """file, vid, x, y, z of PLY files, one file a row of the kernel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                v, _ = decode_ply(data)
                n = len(v["x"])
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]] * n, "vid": np.arange(n), "x": v["x"], "y": v["y"], "z": v["z"]})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(run, "file string, vid long, x double, y double, z double")


def read_ply_faces(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """file, fid, a, b, c: faces cut into fans of triangles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                t = [(f[0], f[i], f[i + 1]) for f in decode_ply(data)[1] for i in range(1, len(f) - 1)]
                a = np.array(t, int).reshape(-1, 3)
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]] * len(a), "fid": np.arange(len(a)), "a": a[:, 0], "b": a[:, 1], "c": a[:, 2]})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(run, "file string, fid long, a long, b long, c long")


def decode_depth_png(data: bytes) -> np.ndarray:
    """Rows of a 16-bit (or 8-bit) grey PNG without interlace."""
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if not head or head[3] != 0 or head[6] != 0 or head[2] not in (8, 16):
        raise ValueError("not a plain grey PNG")
    w, h, depth = head[:3]
    size = depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * size)
    out = np.zeros((h, w * size), np.uint8)
    before = np.zeros(w * size, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = line.reshape(-1, size).cumsum(0).ravel() % 256
        elif kind == 2:
            line = (line + before) % 256
        elif kind in (3, 4):
            for x in range(w * size):
                a = line[x - size] if x >= size else 0
                b, c = before[x], before[x - size] if x >= size else 0
                p = a + b - c
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda q: abs(p - q))
                line[x] = (line[x] + guess) % 256
        out[y] = line
        before = line
    return out.view(">u2").astype(np.uint16).reshape(h, w) if size == 2 else out


def read_depth_images(spark: SparkSession, path: str, scale: float = 0.001, pattern: str = "*.png") -> DataFrame:
    """file, row, col, depth in metres; pixels without a depth are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                image = decode_depth_png(data)
                r, c = np.nonzero(image)
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]] * len(r), "row": r, "col": c, "depth": image[r, c] * scale})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(run, "file string, row int, col int, depth double")


def read_matrix(spark: SparkSession, path: str, columns: list[str], pattern: str = "*") -> DataFrame:
    """file, row and named columns of files of packed little-endian doubles."""
    n = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                m = np.frombuffer(data[: len(data) // (8 * n) * 8 * n], "<f8").reshape(-1, n)
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]] * len(m), "row": np.arange(len(m)), **{c: m[:, i] for i, c in enumerate(columns)}})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(run, "file string, row long, " + ", ".join(f"`{c}` double" for c in columns))


def scan_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, rays) of rows with a pose (x, y, theta) and arrays angles and ranges."""
    rays = frames.select("frame_id", F.posexplode(F.arrays_zip("angles", "ranges")).alias("ray_idx", "_r")).select("frame_id", "ray_idx", F.col("_r.angles").alias("angle"), F.col("_r.ranges").alias("range"))
    return frames.select("frame_id", "x", "y", "theta"), rays


def shifted_poses(poses: DataFrame, dx: float, dy: float) -> DataFrame:
    """Poses (x, y, theta) of a sensor mounted at an offset on a body."""
    c, s = F.cos("theta"), F.sin("theta")
    return poses.withColumn("x", F.col("x") + c * dx - s * dy).withColumn("y", F.col("y") + s * dx + c * dy)


def pair_files(maps: DataFrame, trajectories: DataFrame, file: str = "file") -> DataFrame:
    """Maps and trajectories whose files have one name but for the ending."""
    stem: Column = F.regexp_extract(file, r"^(.*)\.[^.]*$", 1)
    return maps.withColumn("token", stem).drop(file).join(trajectories.withColumn("token", stem).drop(file), "token")


def merge_results(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows by key, the second table's where both have one."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(key, "_r.*")


def filter_results(results: DataFrame, unwanted: list[str], labels: str = "labels") -> DataFrame:
    return results.filter(~F.arrays_overlap(labels, F.array(*map(F.lit, unwanted))))


def write_states(leaves: DataFrame, s: TreeSetting, path: str) -> None:
    """The lossy form of a tree: a row (d, morton, states) for each inner node, two bits a child.

    0: unknown, 1: free, 2: occupied, 3: an inner node. The first child, the least on every axis, has the lowest bits.
    """
    names = axes_of(leaves)
    n = len(names)
    every = nodes(leaves, s).filter("d > 0")
    code = F.call_function("shiftright", morton(names), (F.lit(s.depth) - F.col("d")) * n)
    state = F.when(~F.col("is_leaf"), 3).when(F.col("log_odds") >= s.threshold, 2).otherwise(1).cast("long")
    child = F.col("_code").bitwiseAND(F.lit(2**n - 1))
    rows = every.select((F.col("d") - 1).cast("int").alias("d"), code.alias("_code"), state.alias("_s")).select("d", F.shiftright("_code", n).alias("morton"), F.call_function("shiftleft", F.col("_s"), (child * 2).cast("int")).alias("_s"))
    rows.groupBy("d", "morton").agg(F.sum("_s").cast("int").alias("states")).write.mode("overwrite").parquet(f"{path}/states")
    s.to_frame(leaves.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/setting")


def read_states(spark: SparkSession, path: str, axes: int = 2) -> tuple[DataFrame, TreeSetting]:
    """Leaves of write_states(), at the greatest or least log-odds."""
    s = TreeSetting.from_frame(spark.read.parquet(f"{path}/setting"))
    names = ["kx", "ky", "kz"][:axes]
    told = spark.read.parquet(f"{path}/states").select("d", "morton", "states", F.explode(F.sequence(F.lit(0), F.lit(2**axes - 1))).alias("_c"))
    told = told.select((F.col("d") + 1).alias("d"), (F.shiftleft("morton", axes) + F.col("_c")).alias("_m"), F.call_function("shiftright", F.col("states"), F.col("_c") * 2).bitwiseAND(F.lit(3)).alias("_s")).filter("_s in (1, 2)")
    width = F.pow(F.lit(2.0), F.lit(s.depth) - F.col("d")).cast("int")
    keys = [(k * width + F.floor(width / 2)).cast("int").alias(name) for k, name in zip(unmorton("_m", axes), names, strict=True)]
    return told.select("d", *keys, F.when(F.col("_s") == 2, F.lit(float(s.log_odds_max))).otherwise(F.lit(float(s.log_odds_min))).alias("log_odds")), s


def write_tree(leaves: DataFrame, s: TreeSetting, path: str, tile_depth: int = 4) -> None:
    """Leaves by tile, sorted by Morton code within, so that boxes of cells prune files and row groups; the setting beside them."""
    names = axes_of(leaves)
    code = morton(names)
    placed = leaves.select("d", *names, "log_odds", tile(code, len(names), min(tile_depth, s.depth), s).alias("tile"), code.alias("morton"))
    placed.repartition("tile").sortWithinPartitions("tile", "morton").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/leaves")
    s.to_frame(leaves.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/setting")


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, TreeSetting]:
    leaves = spark.read.parquet(f"{path}/leaves")
    return leaves.select("d", *axes_of(leaves), "log_odds"), TreeSetting.from_frame(spark.read.parquet(f"{path}/setting"))
