"""Operator 4: exact deduplication by counting quotient filters.

Texts are equal if they are identical without white space. Pass 1 reads the texts and keeps a narrow table:
id, length, SHA-256 and a 64-bit fingerprint of the normalised text. Each partition of it builds a counting
quotient filter: the fingerprint's high bits (the quotient) name a block, the low bits (the remainders) are kept sorted
with counts. Filters merge block by block, by merging sorted remainders, and lose nothing. Fingerprints with
a count above one go on to byte verification: their texts alone are read again, grouped by their bytes, with partial
aggregation before the shuffle, so a text moves once from each partition however often it occurs there.

Defined cases: a null text counts as empty, and all empty texts are equal; of repeated rows (same id and text)
one is kept; a null id sorts after all others; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import SPACE, Bloom, build_bloom, join_skewed, keep_rows, materialise, row_key, rows_of, tidy

_DELETE = SPACE.encode()
#: Blocks of a merged filter hold about so many fingerprints.
BLOCK = 1 << 17
_NARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_chars", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary())])


def normalised(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, _DELETE) if text else b""


def fingerprint(norm: bytes) -> int:
    value = xxhash.xxh64_intdigest(norm)
    return value - (1 << 64) if value >> 63 else value


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_chars, fp, sha, and rid, a number for each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, fps, shas = [], [], []
            for v in b.column(2):
                text = v.as_py() or ""
                norm = normalised(text)
                chars.append(len(text))
                fps.append(fingerprint(norm))
                shas.append(hashlib.sha256(norm).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chars, pa.int64()), pa.array(fps, pa.int64()), pa.array(shas, pa.binary())], schema=_NARROW)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, key binary, n_chars long, fp long, sha binary")
    return narrow.withColumn("rid", F.monotonically_increasing_id())


class QuotientFilter:
    """Counts of 64-bit fingerprints: by quotient, sorted remainders with their counts."""

    def __init__(self, q: int):
        self.q, self.blocks = q, {}

    def add(self, fps: np.ndarray) -> None:
        values, counts = np.unique(fps.view(np.uint64), return_counts=True)
        self._put(values, counts.astype(np.int64))

    def _put(self, values: np.ndarray, counts: np.ndarray) -> None:
        quotients = (values >> np.uint64(64 - self.q)).astype(np.int64) if self.q else np.zeros(len(values), np.int64)
        remainders = values & np.uint64((1 << (64 - self.q)) - 1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(quotients)) + 1, [len(values)]]) if len(values) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(quotients[a])
            have = self.blocks.get(k)
            new = (remainders[a:b], counts[a:b])
            self.blocks[k] = merge_runs([have, new]) if have else new


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted (remainders, counts): equal remainders add their counts; nothing is lost."""
    remainders = np.concatenate([r for r, _ in runs])
    counts = np.concatenate([c for _, c in runs])
    order = np.argsort(remainders, kind="stable")  # merges sorted runs
    remainders, counts = remainders[order], counts[order]
    first = np.concatenate([[True], remainders[1:] != remainders[:-1]]) if len(remainders) else np.zeros(0, bool)
    return remainders[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(remainders) else counts


def repeated_fingerprints(narrow: DataFrame, n: int) -> DataFrame:
    """fp, copies: the fingerprints that occur more than once, by merged filters."""
    q = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))) + 3)

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = QuotientFilter(q)
        for b in batches:
            if b.num_rows:
                filt.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        for k, (remainders, counts) in sorted(filt.blocks.items()):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([remainders.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["block", "remainders", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        runs = [(np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64)) for r, c in zip(table.column("remainders").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        remainders, counts = merge_runs(runs)
        many = counts > 1
        fps = remainders[many] | np.uint64((k << (64 - q)) & ((1 << 64) - 1) if q else 0)
        return pa.table({"fp": fps.view(np.int64), "copies": counts[many]})

    filters = narrow.select("fp").mapInArrow(build, "block long, remainders binary, counts binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, copies long")


def verified_texts(docs: DataFrame, repeated: Bloom, text_col: str = "text") -> DataFrame:
    """fp, sha, bytes_no: the distinct texts among the candidates, compared by their bytes.

    bytes_no is 1 unless two different texts share a fingerprint and a SHA-256.
    """
    shared = repeated.bits

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared)
        for b in batches:
            norms = [normalised(v.as_py()) for v in b.column(0)]
            fps = np.array([fingerprint(x) for x in norms], np.int64)
            keep = np.flatnonzero(bloom.has(fps.view(np.uint64))) if len(fps) else []
            yield pa.RecordBatch.from_arrays([pa.array(fps[keep] if len(fps) else [], pa.int64()), pa.array([norms[i] for i in keep], pa.binary())], ["fp", "norm"])

    texts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "fp long, norm binary")
    distinct = texts.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("found"))
    return distinct.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "found").groupBy("fp", "sha").agg(F.sum("found").alias("found"), F.count(F.lit(1)).alias("texts"))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The narrow rows with group_size, keep_id and keep_rid of groups of two and more."""
    narrow = materialise(digests(docs, id_col, text_col), "exact")
    n = rows_of(narrow)
    repeated = materialise(repeated_fingerprints(narrow, n), "exact-fp")
    n_repeated = rows_of(repeated)
    bloom = build_bloom(repeated, "fp", n_repeated)
    texts = materialise(verified_texts(docs, bloom, text_col), "exact-texts")
    if texts.agg(F.max("texts")).first()[0] not in (None, 1):
        raise ValueError("two different texts share a SHA-256")  # verification found what no digest can tell apart
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    groups = narrow.groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")).filter("group_size > 1")
    verified = texts.filter("found > 1").select("fp", "sha")
    groups = materialise(groups.join(verified, ["fp", "sha"], "left_semi").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "exact-groups")
    return join_skewed(narrow, groups, "sha", "group_size", n)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key for every row: the longest text stays, then the smallest id."""
    joined = grouped(docs, id_col, text_col)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "key",
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, materialise(dedup(docs, id_col, text_col).select("key", "kept"), "exact-kept"), id_col, text_col)
