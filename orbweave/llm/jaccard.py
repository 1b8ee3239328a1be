"""Operator 6: n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams. Sets are put in size bands; for the band of the larger set of
a pair, the similarity bounds the number k of features in which two linked sets differ. The feature domain
is partitioned by hash and subsets of the partitions are enumerated so that sets which differ in k features at most
must agree on one subset, a shared signature:

* k <= 7: k//2 + 1 groups of three partitions; in some group one feature differs at most, so one of the
  group's three pairs of partitions agrees (each pair is a signature). Pairs that agree are equal, and so
  equally light: a pair under LIGHT features is signed together with each signature of a second enumeration, by another hash,
  which the two sets must share as well. So no signature stands for nearly nothing.
* k > 7: N = k + 1 + t partitions, each a signature. A set whose partners differ in d features at most agrees with them on
  N - d. It signs the partitions of L features and more, for the largest L that leaves out under N - d of them: of the
  agreeing partitions one at least has L features, and a partner with a lower L signs that too.

Signatures meet in buckets of about a million; those of one set alone, nearly all, go no further. To the shared ones
their sets' sizes and histograms are brought, of a bin for about four features: these bound the difference of two sets from
below and refute nearly all chance meetings; sets that pass are joined into candidate classes by a union-find, so that a
signature shared by thousands of sets costs a comparison each, not all pairs. Only the candidate classes' sets are then
compared exactly, with a prefix filter that loses no link. A class is cut in chunks of bounded size, each compared within
and with the class's PIVOTS, the sets that meet most others; only sets that are still apart from the largest part
are compared with the other chunks. What is returned is each document's component: no link is dropped, and copies
aren't expanded into pairs.

Equal sets are one node, named by a 64-bit digest of the set. Defined cases: null and empty texts have the empty set and
link with nothing; fewer words than n make one n-gram of all words; repeated rows are copies and link; null
ids are never smallest unless alone; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Bloom, Hashes, as_bytes, buckets_of, build_bloom, discard, join_skewed, keep_rows, lower_words, materialise, mix, row_key, rows_of, split_by, tidy, window_hashes
from orbweave.llm.components import Union, connected_components

#: Words in an n-gram, and the least similarity as a fraction.
WORDS, SIMILARITY = 4, (85, 100)
#: Width of a size band, features under which a pair of partitions is light, signatures in a bucket.
RATIO, LIGHT, BUCKET = 1.25, 2, 1 << 20
#: Features of a chunk of a class, and the sets that all of its chunks are compared with.
CHUNK, PIVOTS = 250_000, 4


def shingles(text: bytes | None, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    h = hashes.array(lower_words(text))
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(n, len(h))))


class Bands:
    """Size bands and the partitions of each."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY, ratio: float = RATIO):
        self.num, self.den = similarity
        self.ratio, self.lows, self.plans = ratio, [1], {}

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio)))
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def labels(self, size: int) -> range:
        """Bands in which the larger set of a pair with a set of this size can be."""
        return range(self.band(size), self.band(size * self.den // self.num) + 1)

    def most_different(self, label: int) -> int:
        self.band(self.lows[min(label, len(self.lows) - 1)])
        while len(self.lows) <= label + 1:
            self.band(self.lows[-1])
        return (self.den - self.num) * 2 * (self.lows[label + 1] - 1) // (self.den + self.num)

    def plan(self, label: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(k, the partitions' least hashes, a salt for each signature)."""
        if label not in self.plans:
            k = self.most_different(label)
            n = 1 if k == 0 else 3 * (k // 2 + 1) if k <= 7 else k + 1 + -(-3 * (k + 1) // 10)
            edges = np.array([(j << 64) // n for j in range(n)], np.uint64)
            self.plans[label] = k, edges, mix(np.arange(3 * n, dtype=np.uint64) + np.uint64((label + 1) << 32))
        return self.plans[label]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a sorted set."""
        sums, out, again = _sums(s), [], None
        for label in self.labels(len(s)):
            k, edges, salts = self.plan(label)
            cut = np.append(np.searchsorted(s, edges), len(s))
            part, held = sums[cut[1:]] - sums[cut[:-1]], np.diff(cut)
            if k == 0:
                out.append(mix(part ^ salts[:1]))
            elif k > 7:
                apart = (self.den - self.num) * (len(s) + self.lows[label + 1] - 1) // (self.den + self.num)
                level = np.partition(held, len(held) - apart - 1)[len(held) - apart - 1]
                out.append(mix(part ^ salts[: len(part)])[held >= level])
            else:
                signed, light = _pairs(part, held)
                signed = mix(signed ^ salts[: len(signed)])
                out.append(signed[~light])
                if light.any():
                    if again is None:
                        other = np.sort(mix(s ^ np.uint64(0xA24BAED4963EE407)))
                        again = other, _sums(other)
                    cut = np.append(np.searchsorted(again[0], edges), len(s))
                    second, _ = _pairs(again[1][cut[1:]] - again[1][cut[:-1]], np.diff(cut))
                    out.append(mix(signed[light][:, None] + mix(second ^ salts[: len(second)])[None, :]).ravel())
        return np.concatenate(out)


def _sums(s: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])


def _pairs(part: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of the partitions of each group of three, and whether it is light."""
    g, n = part.reshape(-1, 3), held.reshape(-1, 3)
    odd = np.uint64(0xD6E8FEB86659FD93)
    pairs = np.stack([g[:, 0] * odd + g[:, 1], g[:, 0] * odd + g[:, 2], g[:, 1] * odd + g[:, 2]], 1).ravel()
    return pairs, np.stack([n[:, 0] + n[:, 1], n[:, 0] + n[:, 2], n[:, 1] + n[:, 2]], 1).ravel() < LIGHT


def bins_of(size: int | np.ndarray) -> int | np.ndarray:
    """Bins of the histogram of a set: a power of two, about a quarter of its size; 32 to 16384."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1) / 4)), 5, 14).astype(np.int64)


def histogram(s: np.ndarray) -> np.ndarray:
    n = int(bins_of(len(s)))
    return np.minimum(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def node_of(s: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(s.tobytes())
    return value - (1 << 64) if value >> 63 else value


_SIG = np.dtype([("sig", "<u8"), ("node", "<i8")])
_SET = np.dtype([("node", "<i8"), ("size", "<u4")])


def _blobs(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    parts = list(split_by(bucket, rows))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["bucket", "blob"])


def describe_sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n (the set's size), node and histogram of every document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(250_000)
        for b in batches:
            sizes, nodes, bins = [], [], []
            for v in b.column(2):
                s = shingles(v.as_py(), n, hashes)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                bins.append(histogram(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bins, pa.binary())], ["doc_id", "key", "n", "node", "bins"])

    return docs.select(F.col(id_col).cast("long"), row_key(id_col, text_col), as_bytes(text_col)).mapInArrow(run, "doc_id long, key binary, n long, node long, bins binary")


def sign(docs: DataFrame, n: int, similarity: tuple[int, int], buckets: int, text_col: str) -> DataFrame:
    """bucket, blob: (signature, node) of every set, once from each task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen, held, count = Hashes(250_000), Bands(similarity), set(), [], 0
        for b in batches:
            for v in b.column(0):
                s = shingles(v.as_py(), n, hashes)
                node = node_of(s) if len(s) else None
                if node is None or node in seen:  # copies here sign once
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                sigs = bands.signatures(s)
                rows = np.zeros(len(sigs), _SIG)
                rows["sig"], rows["node"] = sigs, node
                held.append(rows)
                count += len(rows)
                if count > 500_000:
                    rows = np.concatenate(held)
                    yield _blobs(rows, buckets_of(rows["sig"], buckets))
                    held, count = [], 0
        if held:
            rows = np.concatenate(held)
            yield _blobs(rows, buckets_of(rows["sig"], buckets))

    return docs.select(as_bytes(text_col)).mapInArrow(run, "bucket long, blob binary")


def _all(table: pa.Table, kind: np.dtype, column: str = "blob") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(column) if x.is_valid)])


def shared_signatures(signed: DataFrame, groups: int) -> DataFrame:
    """bucket (of nodes), blob: the signatures that two sets share at least; most have one set and end here."""

    def run(table: pa.Table) -> pa.Table:
        rows = _all(table, _SIG)
        rows = rows[np.lexsort((rows["node"], rows["sig"]))]
        rows = rows[np.concatenate([[True], (rows["sig"][1:] != rows["sig"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])]
        same = rows["sig"][1:] == rows["sig"][:-1]
        rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        return pa.Table.from_batches([_blobs(rows, buckets_of(rows["node"].copy().view(np.uint64), groups))])

    return signed.groupBy("bucket").applyInArrow(run, "bucket long, blob binary")


class Sets:
    """Sizes and histograms of sets, in the order of their nodes."""

    def __init__(self, heads: np.ndarray, bins: np.ndarray):
        order = np.argsort(heads["node"], kind="stable")
        widths = bins_of(heads["size"].astype(np.int64)) if len(heads) else np.zeros(0, np.int64)
        starts = np.cumsum(widths) - widths
        order = order[np.concatenate([[True], heads["node"][order][1:] != heads["node"][order][:-1]])] if len(order) else order
        self.node, self.size = heads["node"][order], heads["size"][order].astype(np.int64)
        self.width, self.start, self.bins = widths[order], starts[order], bins

    def some(self, at: np.ndarray) -> tuple[bytes, bytes]:
        """Heads and histograms of some sets."""
        heads = np.zeros(len(at), _SET)
        heads["node"], heads["size"] = self.node[at], self.size[at]
        return heads.tobytes(), b"".join(self.bins[a : a + w].tobytes() for a, w in zip(self.start[at].tolist(), self.width[at].tolist(), strict=True))

    def near(self, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Whether pairs may be linked: sizes and histograms differ by no more than linked sets can."""
        num, den = similarity
        both, fits = self.size[a] + self.size[b], np.zeros(len(a), bool)
        able = np.flatnonzero((den - num) * both >= (den + num) * np.abs(self.size[a] - self.size[b]))
        kinds = self.width[a[able]] * 65536 + self.width[b[able]]
        for kind in np.unique(kinds).tolist():
            wa, wb = divmod(kind, 65536)
            least, mine = min(wa, wb), able[kinds == kind]
            for k in range(0, len(mine), max(1, (1 << 21) // max(wa, wb))):
                p = mine[k : k + max(1, (1 << 21) // max(wa, wb))]
                # a histogram of more bins folds to one of fewer
                x, y = (self.bins[self.start[c[p]][:, None] + np.arange(w)].reshape(len(p), -1, least).sum(1, dtype=np.int32) for c, w in ((a, wa), (b, wb)))
                fits[p] = (den - num) * both[p] >= (den + num) * np.abs(x - y).sum(1)
        return fits


def _sets(table: pa.Table) -> Sets:
    return Sets(_all(table, _SET, "heads"), _all(table, np.dtype(np.uint8), "bins"))


_FULL = "bucket long, blob binary, heads binary, bins binary"


def attach_sets(shared: DataFrame, nodes: DataFrame, groups: int, buckets: int) -> DataFrame:
    """bucket (of signatures), blob, heads, bins: shared signatures, and once for each piece the sizes and histograms of its sets."""

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = np.zeros(b.num_rows, _SET)
            heads["node"], heads["size"] = b.column("node").to_numpy(), b.column("n").to_numpy()
            bins = b.column("bins").to_pylist()
            parts = list(split_by(buckets_of(heads["node"].copy().view(np.uint64), groups), np.arange(len(heads))))
            yield _full([k for k, _ in parts], [None] * len(parts), [heads[at].tobytes() for _, at in parts], [b"".join(bins[i] for i in at) for _, at in parts])

    def run(table: pa.Table) -> pa.Table:
        sets, sigs = _sets(table), _all(table, _SIG)
        at = np.searchsorted(sets.node, sigs["node"])
        parts = list(split_by(buckets_of(sigs["sig"], buckets), sigs, at))
        with_sets = [sets.some(np.unique(where)) for _, _, where in parts]
        return pa.Table.from_batches([_full([k for k, _, _ in parts], [x.tobytes() for _, x, _ in parts], [h for h, _ in with_sets], [x for _, x in with_sets])])

    described = nodes.select("node", "n", "bins").mapInArrow(send, _FULL)
    both = shared.selectExpr("bucket", "blob", "cast(null as binary) heads", "cast(null as binary) bins").unionByName(described)
    return both.groupBy("bucket").applyInArrow(run, _FULL)


def _full(buckets: list, blobs: list, heads: list, bins: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *(pa.array(x, pa.binary()) for x in (blobs, heads, bins))], ["bucket", "blob", "heads", "bins"])


def candidate_links(full: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b, meets: a spanning forest, for each bucket, of the sets that share a signature and may be linked.

    Rows with a = b tell how many others a set meets in the bucket's signatures.
    """

    def run(table: pa.Table) -> pa.Table:
        sets, rows = _sets(table), _all(table, _SIG)
        order = np.lexsort((rows["node"], rows["sig"]))
        sigs, at = rows["sig"][order], np.searchsorted(sets.node, rows["node"][order])
        starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(sigs)))
        meets = np.bincount(at, np.repeat(counts - 1, counts), len(sets.node)).astype(np.int64)
        starts, counts = starts[counts > 1], counts[counts > 1]
        union = Union(len(sets.node))
        # each member with the first of its signature, then the rest
        a = np.repeat(at[starts], counts - 1)
        b = at[np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] if len(starts) else at[:0]
        b = np.delete(b, np.cumsum(counts) - counts) if len(starts) else b
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        for x, y in pairs[sets.near(pairs[:, 0], pairs[:, 1], similarity)].tolist():
            union.join(x, y)
        done = set()
        # members that are one class already stay one: nearly all signatures, as most copies link with the first
        whole = np.array([union.find(x) for x in range(len(sets.node))], np.int64)[at]
        for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
            if c > 2 and (whole[s : s + c] != whole[s]).any():
                members = at[s : s + c]
                key = members.tobytes()
                if key not in done:
                    done.add(key)
                    _join_rest(members, union, sets, similarity)
        roots = np.array([union.find(x) for x in range(len(sets.node))], np.int64)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        met = np.flatnonzero(meets)
        return pa.table({"a": np.concatenate([sets.node[roots[moved]], sets.node[met]]), "b": np.concatenate([sets.node[moved], sets.node[met]]), "meets": np.concatenate([np.zeros(len(moved), np.int64), meets[met]])})

    return full.groupBy("bucket").applyInArrow(run, "a long, b long, meets long")


def _join_rest(members: np.ndarray, union: Union, sets: Sets, similarity: tuple[int, int]) -> None:
    """Compares members that are still apart: the smallest class with all others, until it joins one or is left alone."""
    classes: dict[int, list[int]] = {}
    for x in members.tolist():
        classes.setdefault(union.find(x), []).append(x)
    while len(classes) > 1:
        root = min(classes, key=lambda r: len(classes[r]))
        mine = classes.pop(root)
        others = np.array([x for xs in classes.values() for x in xs])
        for x in mine:
            hits = set()
            for k in range(0, len(others), 100_000):
                part = others[k : k + 100_000]
                hits |= {union.find(y) for y in part[sets.near(np.full(len(part), x), part, similarity)].tolist()}
            if hits - {union.find(x)}:
                for r in hits:
                    union.join(x, r)
                break
        else:
            continue  # alone
        joined: dict[int, list[int]] = {}
        for xs in [mine, *classes.values()]:
            joined.setdefault(union.find(xs[0]), []).extend(xs)
        classes = joined


def link_sets(sets: list[np.ndarray], similarity: tuple[int, int], parts: list[int] | None = None) -> Union:
    """The classes of sorted sets under links, exactly. parts: sets of the same part are known to be connected."""
    num, den = similarity
    union = Union(len(sets))
    known: dict[int, int] = {}
    for i, p in enumerate(parts or []):
        union.join(known.setdefault(p, i), i)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if den * len(a) < num * len(b):
            return False
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return den * both >= num * (len(a) + len(b) - both)

    leaders: list[int] = []
    for i in order:  # most members of a class of copies are linked with one of its first
        for x in leaders[-4:]:
            if union.find(x) == union.find(i) or linked(sets[x], sets[i]):
                union.join(x, i)
                break
        else:
            leaders.append(i)
    if len({union.find(i) for i in order}) == 1:
        return union
    # features in order of frequency: linked sets share one of their first n - ceil(n * similarity) + 1
    values, rank, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(values))
    shared = counts > 1
    cuts = np.cumsum([0, *map(len, sets)])
    posting: dict[int, list[int]] = {}
    for i in order:
        s = sets[i]
        own = rank[cuts[i] : cuts[i + 1]]
        first = len(s) + num * len(s) // -den + 1
        prefix = own[np.argsort(place[own], kind="stable")[:first]]
        met: set[int] = set()
        mine = union.find(i)
        for f in prefix[shared[prefix]].tolist():
            have = posting.setdefault(f, [])
            for j in have:
                if j not in met:
                    met.add(j)
                    if union.find(j) != mine and linked(sets[j], s):
                        union.join(i, j)
                        mine = union.find(i)
            have.append(i)
    return union


def candidate_sets(docs: DataFrame, members: Bloom, n: int, text_col: str) -> DataFrame:
    """node, feats: the sets that are in candidate classes, and a few others."""
    bits = members.bits

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bloom, seen = Hashes(250_000), Bloom(bits), set()
        for b in batches:
            nodes, sets = [], []
            for v in b.column(0):
                s = shingles(v.as_py(), n, hashes)
                node = node_of(s) if len(s) else None
                if node is not None and node not in seen and (node & ((1 << 64) - 1)) in bloom:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "feats"])

    return docs.select(as_bytes(text_col)).mapInArrow(run, "node long, feats binary")


def compared(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, classes: DataFrame, n: int, similarity: tuple[int, int], text_col: str) -> tuple[DataFrame, bool]:
    """a, b: links that connect what is linked within each candidate class, by exact comparison of whole sets.

    The flag tells that no class was cut, so that each component is a star around a.
    """
    bloom = build_bloom(classes, "node", rows_of(classes))
    sets = candidate_sets(docs, bloom, n, text_col).groupBy("node").agg(F.any_value("feats").alias("feats"))
    sized = classes.join(nodes.select("node", "n"), "node")
    of = sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.lit(1), F.ceil(F.sum("n") / CHUNK)).cast("int").alias("chunks"))
    chunk = lambda chunks: F.pmod(F.xxhash64("node"), chunks).cast("int")
    placed = join_skewed(classes, of, "root", "members", rows_of(classes)).withColumn("chunk", chunk(F.col("chunks")))
    placed = materialise(sets.join(placed, "node").select("node", "feats", "root", "chunks", "chunk"), "jaccard-sets")
    several = placed.filter("chunks > 1")
    # the sets that meet most others, of each PIVOTS-th part of a class, go to all of its chunks
    met = candidates.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("meets").alias("meets"))
    best = several.select("node", "root", "chunks").join(met, "node").groupBy("root", "chunks", F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.lit(PIVOTS)).alias("part"))
    best = best.agg(F.max(F.struct("meets", "node")).alias("best")).select(F.col("best.node").alias("node"), "root", F.sequence(F.lit(0), F.col("chunks") - 1).alias("to"))
    pivots = several.select("node", "feats", "chunk").join(best, "node").select("node", "feats", "root", "chunk", F.explode("to").alias("in"))
    inner = placed.select("node", "feats", "root", F.col("chunk").alias("in")).unionByName(pivots.filter("chunk <> in").select("node", "feats", "root", "in"))

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        of = table.column("node").to_numpy()[order]
        feats = table.column("feats").to_pylist()
        parts = table.column("part").to_numpy()[order].tolist() if "part" in table.column_names else None
        union = link_sets([np.frombuffer(feats[i], np.uint64) for i in order], similarity, parts)
        roots = np.array([union.find(i) for i in range(len(of))], np.int64)
        moved = np.flatnonzero(roots != np.arange(len(of)))
        return pa.table({"a": of[roots[moved]], "b": of[moved]})

    links = materialise(inner.groupBy("root", "in").applyInArrow(compare, "a long, b long"), "jaccard-links")
    stars = rows_of(several.limit(1)) == 0
    if not stars:
        links = links_across(several, links, compare)
    discard(placed)
    return links, stars


def links_across(several: DataFrame, links: DataFrame, compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The links within chunks, with those between chunks of sets that these leave apart.

    Of each class the sets outside its largest part, cut in chunks anew, are compared with all of its chunks.
    """
    parts = connected_components(links).withColumnRenamed("root", "part")
    known = several.select("node", "root", "chunks", "chunk").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    known = materialise(known, "jaccard-parts")
    sizes = known.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("root").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("members"), F.max(F.struct("n", "part"))["part"].alias("largest")).filter("of > 1")
    known = join_skewed(known, largest, "root", "members", rows_of(known), "inner")
    apart = F.col("part") != F.col("largest")
    rest = known.filter(apart).join(several.select("node", F.octet_length("feats").alias("bytes")), "node").groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / 8 / CHUNK)).cast("int").alias("rests"), F.first("members").alias("members"))
    known = materialise(join_skewed(known.drop("members"), rest, "root", "members", rows_of(known), "inner"), "jaccard-apart")
    second = F.pmod(F.xxhash64(F.lit("rest"), "node"), F.col("rests")).cast("int")
    mine = known.filter(apart).select("node", "part", "root", second.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    theirs = known.select("node", "part", "root", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.col("chunk").alias("j"))
    met = mine.unionByName(theirs).distinct().join(several.select("node", "feats"), "node")
    across = met.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")
    every = materialise(links.unionByName(across), "jaccard-links")
    discard(links)
    return every


def components(docs: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and the row's key for every row."""
    return rows_of_classes(docs, n, similarity, id_col, text_col).drop("root")


def rows_of_classes(docs: DataFrame, n: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """components() with root besides, a node of each component: it tells apart those whose ids are all null. Rows without words have none."""
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    num, den = similarity
    buckets = max(1, int(total / 6 * 4 * (den - num) / (den + num)) // BUCKET)
    narrow = materialise(describe_sets(docs, n, id_col, text_col), "partenum")
    nodes = narrow.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("bins").alias("bins"))
    nodes = materialise(nodes, "partenum-nodes")
    fewer = max(1, buckets // 4)
    full = attach_sets(shared_signatures(sign(docs, n, similarity, buckets, text_col), fewer), nodes, fewer, fewer)
    candidates = materialise(candidate_links(full, similarity), "partenum-links")
    classes = materialise(connected_components(candidates), "partenum-classes")
    links, stars = compared(docs, nodes, candidates, classes, n, similarity, text_col)
    discard(candidates, classes)
    linked = links.select(F.col("b").alias("node"), F.col("a").alias("root")) if stars else connected_components(links)
    linked = nodes.select("node", "least", "copies").join(linked, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = materialise(join_skewed(linked.select("node", "copies", "root"), smallest, "root", "members", rows_of(nodes)), "jaccard-classes")
    named = named.select("node", "copies", "root", "component_id")
    joined = join_skewed(narrow, named, "node", "copies", rows_of(narrow))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", "key")


def one_of_each(docs: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their component, one of each component, with all their columns.

    Rows without words are no copies of each other and stay. Null ids come last; where all are null one row stays just so.
    """
    found = materialise(rows_of_classes(docs, n, similarity, id_col, text_col), "jaccard-rows")
    worded = F.col("n_shingles") > 0
    first = found.filter(worded & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("key"))
    kept = first.select("key").unionByName(found.filter(~worded).select("key")).distinct().withColumn("kept", F.lit(True))
    decided = found.select("key").join(kept, "key", "left").select("key", F.coalesce("kept", F.lit(False)).alias("kept"))
    # of rows that are copies in id and text one stays: a second is as good as dropped
    again = decided.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(False).alias("kept"))
    return keep_rows(docs, decided.unionByName(again), id_col, text_col)
