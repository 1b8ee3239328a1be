"""Operator 10: copies among images by local descriptors.

Corners are found at several scales, turned to the direction of their patch's intensity centroid, and described by 256
binary tests on a patch of 31 x 31 pixels. Each of BANDS hash tables joins on its own BAND bits, drawn from all 256; pairs of
images that share SHARED cells at least (a link has AGREE corners in common, each in all tables) are compared corner by corner, and
linked if enough matched corners agree on one turn, scale and shift. The tables are not complete for the 40 bits that a match may differ in: a test holds their recall against brute force at 0.9 at least for
each of contrast, brightness, noise, recompression, blur, resizing, turns by any angle and crops.

Equal images are one node, so that any number of copies costs one. Images are dealt into blocks of about MEETING corners,
and each pair of blocks gets the cells that its images share, counts them and compares the pairs that share enough; pairs
never become rows, and an image's corners go once to each pair of blocks. The strongest corners are taken
in each tile of at most TILE pixels a side, so that a crop of a small part of a large image keeps corners of its own.

Images are binary PGM. Defined cases: null, empty or undecodable images have no corners and are linked with nothing, not
even equal ones; images without enough corners link with equal images only; repeated rows are equal images; an empty table gives no rows;
only the id and image columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import buckets_of, discard, join_skewed, materialise, rows_of, split_by, tidy
from orbweave.llm.components import Union, connected_components

CORNERS, BANDS, BAND, SHARED, REACH, EDGE, SCALES = 24, 8, 48, 2, 15, 11, (1, 2)
#: Bits of a match at most, corners that must agree, and the pixels by which they may be off.
APART, AGREE, SLACK = 40, 6, 3.0
TILE, BUCKET, MEETING = 64, 1 << 20, 1 << 15
#: Binary tests: pairs of places in a patch, from a fixed seed.
_TESTS = np.clip(np.random.default_rng(11).normal(0, 6.2, (256, 2, 2)), -REACH, REACH)
_TURNS = 32
#: The bits that each hash table joins on.
_BITS = np.stack([np.random.default_rng(100 + j).permutation(256)[:BAND] for j in range(BANDS)])
_KIND = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "u1", 32)])


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    body = np.frombuffer(data, np.uint8, offset=m.end())
    return body[: w * h].reshape(h, w) if w * h and len(body) >= w * h else None


def _smooth(a: np.ndarray, r: int) -> np.ndarray:
    """Box mean of radius r."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def _described(a: np.ndarray, y: np.ndarray, x: np.ndarray, s: int) -> np.ndarray:
    """The corners at y, x of an image at scale s, with their descriptors."""
    h, w = a.shape
    span = np.arange(-7, 8)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    disc = dy**2 + dx**2 <= 49
    dy, dx = dy[disc], dx[disc]
    patch = a[y[:, None] + dy, x[:, None] + dx]
    angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
    turn = np.round(angle / (2 * np.pi) * _TURNS) / _TURNS * 2 * np.pi
    c, n = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    tx, ty = _TESTS[None, :, :, 0], _TESTS[None, :, :, 1]
    px = np.clip(np.round(x[:, None, None] + tx * c - ty * n).astype(int), 0, w - 1)
    py = np.clip(np.round(y[:, None, None] + tx * n + ty * c).astype(int), 0, h - 1)
    v = a[py, px]
    rows = np.zeros(len(x), _KIND)
    rows["x"], rows["y"], rows["angle"], rows["scale"] = x * s, y * s, angle, s
    rows["bits"] = np.packbits(v[:, :, 0] < v[:, :, 1] - 0.5, axis=1)
    return rows


def describe(image: np.ndarray, most: int = CORNERS) -> np.ndarray:
    """The strongest corners of each tile at all scales, `most` a tile, with their descriptors."""
    out = []
    for s in SCALES:
        h, w = image.shape[0] // s, image.shape[1] // s
        if min(h, w) < 2 * EDGE + 4:
            continue
        a = image[: h * s, : w * s].reshape(h, s, w, s).mean((1, 3))
        a = _smooth(a, 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
        strong = xx * yy - xy**2 - 0.05 * (xx + yy) ** 2
        peak = strong[1:-1, 1:-1]
        around = np.stack([strong[1 + i : h - 1 + i, 1 + j : w - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        top = np.zeros((h, w), bool)
        top[1:-1, 1:-1] = (peak > around.max(0)) & (peak > 1.0)
        top[:EDGE] = top[-EDGE:] = False
        top[:, :EDGE] = top[:, -EDGE:] = False
        y, x = np.nonzero(top)
        rows, columns = -(-h // TILE), -(-w // TILE)
        tile = y * rows // h * columns + x * columns // w
        order = np.lexsort((-strong[y, x], tile))
        first = np.searchsorted(tile[order], tile[order])
        keep = order[np.arange(len(order)) - first < most]
        y, x = y[keep], x[keep]
        if not len(x):
            continue
        out.extend(_described(a, y[k : k + 2048], x[k : k + 2048], s) for k in range(0, len(x), 2048))
    return np.concatenate(out) if out else np.zeros(0, _KIND)


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """Matched corners that agree on one similarity transform, at best; no more are looked for once `enough` do."""
    if not len(a) or not len(b):
        return 0
    first, second = (np.ascontiguousarray(x["bits"]).view("<u8") for x in (a, b))
    i, j, apart = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    step = max(1, (1 << 20) // len(b))
    for k in range(0, len(a), step):
        far = np.bitwise_count(first[k : k + step, None, :] ^ second[None, :, :]).sum(2)
        j[k : k + step] = far.argmin(1)
        apart[k : k + step] = far.min(1)
    ok = apart <= APART
    i, j = i[ok], j[ok]
    if len(i) < AGREE:
        return 0
    p = np.stack([a["x"][i], a["y"][i]], 1).astype(float)
    q = np.stack([b["x"][j], b["y"][j]], 1).astype(float)
    best = 0
    turn = b["angle"][j] - a["angle"][i]
    grow = b["scale"][j] / a["scale"][i]
    for k in range(len(i)):  # each match proposes a transform
        c, s = np.cos(turn[k]) * grow[k], np.sin(turn[k]) * grow[k]
        d = p - p[k]
        at = q[k] + np.stack([d[:, 0] * c - d[:, 1] * s, d[:, 0] * s + d[:, 1] * c], 1)
        near = np.hypot(*(at - q).T) <= SLACK * max(1.0, grow[k])
        if near.sum() > best:
            best = max(best, len({(x, y) for x, y in p[near].round(0).tolist()}))
            if enough is not None and best >= enough:
                break
    return best


def corner_table(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """id, node (of equal images; null if undecodable) and corners for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, corners = [], []
            for v in b.column(1):
                image = decode_pgm(v.as_py())
                nodes.append(None if image is None else xxhash.xxh3_64_intdigest(image.tobytes(), image.shape[1]) >> 1)
                corners.append(b"" if image is None else describe(image).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(corners, pa.binary())], ["id", "node", "corners"])

    return images.select(F.col(id_col).cast("long"), F.col(image_col)).mapInArrow(tidy(run), "id long, node long, corners binary")


def shared_cells(nodes: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """low, high, two, more: for pairs of blocks of images, the cells that their images share.

    A cell of two images is a pair in `two`; a larger one is in `more` as two counts and the images of each block, so that
    a cell costs its images once a block, not its pairs.
    """
    kind = np.dtype([("cell", "<u8"), ("node", "<i8")])
    places = np.uint64(1) << np.arange(BAND, dtype=np.uint64)

    def blobs(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        parts = list(split_by(buckets_of(rows["cell"], buckets), rows))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["bucket", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for node, corners in zip(b.column("node").to_pylist(), b.column("corners").to_pylist(), strict=True):
                every = np.frombuffer(corners, _KIND)
                for k in range(0, len(every), 4096):
                    bits = np.unpackbits(every["bits"][k : k + 4096], axis=1).astype(np.uint64)
                    cells = np.zeros((len(bits), BANDS), kind)
                    cells["cell"] = (bits[:, _BITS] * places).sum(2, dtype=np.uint64) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND))
                    cells["node"] = node
                    held.append(cells.ravel())
                    n += cells.size
                    if n >= 1 << 20:
                        yield blobs(held)
                        held, n = [], 0
            if held:
                yield blobs(held)

    def meet(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, kind) for x in table.column("blob").to_pylist()])
        home = rows["node"] % blocks
        order = np.lexsort((rows["node"], home, rows["cell"]))
        rows, home = rows[order], home[order]
        fresh = np.concatenate([[True], (rows["cell"][1:] != rows["cell"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
        rows, home = rows[fresh], home[fresh]
        starts = np.flatnonzero(np.concatenate([[True], rows["cell"][1:] != rows["cell"][:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        two = starts[sizes == 2]
        out = [(divmod(k, blocks), x.tobytes(), b"") for k, x in split_by(home[two] * blocks + home[two + 1], np.stack([rows["node"][two], rows["node"][two + 1]], 1))]
        more: dict[tuple[int, int], list[np.ndarray]] = {}
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            node, at = rows["node"][start : start + size], home[start : start + size]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            parts = list(zip(at[cut].tolist(), np.split(node, cut[1:]), strict=True))
            for i, (low, first) in enumerate(parts):
                if len(first) > 1:
                    more.setdefault((low, low), []).extend([np.array([len(first), 0]), first])
                for high, second in parts[i + 1 :]:
                    more.setdefault((low, high), []).extend([np.array([len(first), len(second)]), first, second])
        out.extend((k, b"", np.concatenate(x).astype("<i8").tobytes()) for k, x in more.items())
        return pa.table(
            {"low": pa.array([k[0] for k, _, _ in out], pa.int64()), "high": pa.array([k[1] for k, _, _ in out], pa.int64())}
            | {"two": pa.array([x for _, x, _ in out], pa.binary()), "more": pa.array([x for _, _, x in out], pa.binary())}
        )

    cells = nodes.mapInArrow(tidy(send), "bucket long, blob binary")
    return cells.groupBy("bucket").applyInArrow(meet, "low long, high long, two binary, more binary")


def candidates(nodes: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """low, high, node, partners: in each pair of blocks, the images that share SHARED cells at least with one of `partners`, or are a partner.

    Cells are counted in a table of one block by the other, whose size the blocks bound.
    """

    def count(table: pa.Table) -> pa.Table:
        two = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("two").to_pylist()]).reshape(-1, 2)
        more = [np.frombuffer(x, "<i8") for x in table.column("more").to_pylist()]
        lists = []
        for x in more:
            k = 0
            while k < len(x):
                m, n = x[k : k + 2].tolist()
                first = x[k + 2 : k + 2 + m]
                lists.append((first, x[k + 2 + m : k + 2 + m + n] if n else first))
                k += 2 + m + n
        left = np.unique(np.concatenate([two[:, 0], *(a for a, _ in lists)]))
        right = np.unique(np.concatenate([two[:, 1], *(b for _, b in lists)]))
        met = np.zeros((len(left), len(right)), np.uint8)
        for a, b in lists:
            here = np.ix_(np.searchsorted(left, a), np.searchsorted(right, b))
            met[here] = np.minimum(met[here], SHARED - 1) + np.uint8(1)
        i, j = np.searchsorted(left, two[:, 0]), np.searchsorted(right, two[:, 1])
        for _ in range(SHARED):  # a pair that occurs again counts again
            once = np.unique(np.stack([i, j], 1), axis=0, return_index=True)[1]
            met[i[once], j[once]] = np.minimum(met[i[once], j[once]], SHARED - 1) + np.uint8(1)
            again = np.ones(len(i), bool)
            again[once] = False
            i, j = i[again], j[again]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        enough = met >= SHARED
        if low == high:
            enough &= left[:, None] < right[None, :]
        rows = dict.fromkeys(right[enough.any(0)].tolist(), b"")
        rows |= {int(left[k]): right[enough[k]].tobytes() for k in np.flatnonzero(enough.any(1))}
        n = len(rows)
        return pa.table({"low": pa.array([low] * n, pa.int64()), "high": pa.array([high] * n, pa.int64()), "node": pa.array(list(rows), pa.int64()), "partners": pa.array(list(rows.values()), pa.binary())})

    shared = shared_cells(nodes, buckets, blocks)
    return shared.groupBy("low", "high").applyInArrow(count, "low long, high long, node long, partners binary")


def links_of(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, n: for each image of a pair of blocks, the image b that stands for those linked with it there and the number n of its links.

    Rows are images, not pairs: links count where they are found, and of those that join images already joined only the count goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, corners, partners = None, {}, {}

        def found() -> pa.RecordBatch:
            names = sorted(corners)
            at = {x: k for k, x in enumerate(names)}
            sets, degree = Union(len(names)), [0] * len(names)
            for a, blob in partners.items():
                for b in np.frombuffer(blob, "<i8").tolist():
                    if consensus(corners[a], corners[b], AGREE) >= AGREE:
                        sets.join(at[a], at[b])
                        degree[at[a]] += 1
                        degree[at[b]] += 1
            yes = [k for k, n in enumerate(degree) if n]
            columns = [[names[k] for k in yes], [names[sets.find(k)] for k in yes], [degree[k] for k in yes]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "n"])

        for batch in batches:
            for low, high, node, some, blob in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "node", "partners", "corners")), strict=True):
                if (low, high) != here:
                    if corners:
                        yield found()
                    here, corners, partners = (low, high), {}, {}
                corners[node] = np.frombuffer(blob, _KIND)
                if some:
                    partners[node] = some
        if corners:
            yield found()

    dealt = met.join(nodes.select("node", "corners"), "node").repartition("low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInArrow(tidy(run), "a long, b long, n long")


def copies(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """id, n_corners, class_id (the smallest id among an image's copies) and n_links (distinct images it is linked with)."""
    table = materialise(corner_table(images, id_col, image_col), "corners")
    known = table.filter("node is not null")
    nodes = materialise(known.groupBy("node").agg(F.any_value("corners").alias("corners"), F.min("id").alias("least"), F.count(F.lit(1)).alias("members")), "corner-nodes")
    n = rows_of(nodes)
    several = nodes.filter(F.octet_length("corners") >= AGREE * _KIND.itemsize).select("node", "corners")
    corners = (several.agg(F.sum(F.octet_length("corners"))).first()[0] or 0) // _KIND.itemsize
    met = materialise(candidates(several, max(1, corners * BANDS // BUCKET), max(1, corners // MEETING)), "image-candidates")
    links = materialise(links_of(met, several), "image-links")
    discard(met)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    rooted = nodes.select("node", "least", "members").join(connected_components(links.select("a", "b")), "node", "left").select("node", "least", "members", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("nodes"))
    named = materialise(join_skewed(rooted, smallest, "root", "nodes", n).join(degree, "node", "left").select("node", "members", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "image-classes")
    rows = table.select("id", "node", F.floor(F.octet_length("corners") / _KIND.itemsize).cast("long").alias("n_corners"))
    joined = join_skewed(rows, named, "node", "members", rows_of(rows))
    return joined.select("id", "n_corners", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def render(vector: Column, side: int = 8, zoom: int = 8) -> Column:
    """An image of a vector: its first side x side values as a grid of squares, from dark to light."""
    import pandas as pd

    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vectors:
            out = []
            for v in s:
                if v is None or len(v) < side * side or not np.isfinite(v[: side * side]).all():
                    out.append(None)
                    continue
                g = np.asarray(v[: side * side], float).reshape(side, side)
                low, high = g.min(), g.max()
                g = (g - low) / (high - low) * 255 if high > low else g * 0
                out.append(encode_pgm(np.kron(g, np.ones((zoom, zoom))).round().astype(np.uint8)))
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"vectors": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(vector)
