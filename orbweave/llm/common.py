"""What the corpus operators share: white space, shared storage, token hashing and bounded filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: Where tables go on one machine if the session names no shared folder.
FALLBACK_DIR = "file:///tmp/checkpoints/orbweave"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Unset, only one machine has one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor costs a re-read, not a recomputation, and every reader sees the same rows. discard() removes the table.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.orbweave_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise() wrote and that nothing lazy reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.orbweave_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that docs hasn't, in any case."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel over batches that gives its memory back once it is done: Python workers live on, and would hold it through later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(data: bytes | str | None) -> list[bytes]:
    """Maximal runs of bytes outside SPACE of a UTF-8 text: bytes.split() knows just these as white space."""
    if isinstance(data, str):
        data = data.encode("utf-8", "surrogatepass")
    return data.split() if data else []


def lower_words(data: bytes | None) -> list[bytes]:
    """words() with A to Z in lower case and nothing else changed."""
    return data.lower().split() if data else []


def as_bytes(text_col: str) -> Column:
    """A text column as the bytes that it is stored in, which spares decoding them."""
    return F.col(text_col).cast("binary")


class Hashes(dict):
    """Word to 64-bit hash; forgets everything when `limit` words are held, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[np.uint64, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n-1 modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        more = np.full(max(n, 1 << 18), base, np.uint64)
        more[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(more)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` consecutive values of h, by Horner's rule over the run."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length <= 8:
        out = h[:n].copy()
        for j in range(1, length):
            out = out * _BASE + h[j : j + n]
        return mix(out)
    # prefix sums of h[i] * B^(-i): a run's sum times B^(its end) doesn't depend on where it is
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_INVERSE, len(h)), dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * _powers(_BASE, n))


class Bloom:
    """A bit set of fixed size with two probes. A false positive costs work later, never a wrong row."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.uint64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for p in probes(values):
            p = p & self.mask
            found &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def probes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return m, m >> np.uint64(33)


#: Log2 of the bits of a Bloom filter at most (64 MB), and the slices of one level of in_levels().
MOST_BITS, FEW = 29, 64


def bloom_bits(n: int, most: int = MOST_BITS) -> int:
    """Log2 of the bits for n members: 16 bits a member, 2**most bits at most whatever n is.

    At the most, half the filter's bits are set by 190 million members; beyond, it passes more rows on, never fewer.
    """
    return min(most, max(16, math.ceil(math.log2(16 * max(n, 1)))))


def build_bloom(df: DataFrame, column: str, n: int) -> Bloom:
    """A Bloom filter of the long column of df.

    Tasks send pieces of their bitmaps, which are joined by OR in groups of at most FEW tasks, level by level, before the
    driver gets them; the driver holds 2**MOST_BITS bits at most, so what is broadcast later doesn't grow with the data. It
    gets the pieces by one job: they are as many as the filter's size has, not the data's, and a job a partition takes far longer.
    """
    log2 = bloom_bits(n)
    part = 1 << 15  # bytes of a piece

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        seen = False
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            seen |= len(v) > 0
            for p in probes(v):
                p = p & np.uint64((1 << log2) - 1)
                np.bitwise_or.at(bits, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        for k in range(0, len(bits) if seen else 0, part):
            if bits[k : k + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits[k : k + part].tobytes()], pa.binary())], ["piece", "bits"])

    def either(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    source = df.select(F.col(column).cast("long"))
    pieces = in_levels(source.mapInArrow(partial, "piece long, bits binary"), "piece", either, "piece long, bits binary")
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    for row in pieces.collect():
        bits[row.piece : row.piece + part] = np.frombuffer(row.bits, np.uint8)[: len(bits) - row.piece]
    return Bloom(bits)


def in_levels(parts: DataFrame, key: str, join: Callable[[pa.Table], pa.Table], schema: str, levels: int = 2) -> DataFrame:
    """Joins the rows of each key by an associative function, in groups that hold the root of the number of tasks.

    One group of a blob from each of t tasks would grow with t. Each row is put in one of FEW**level slices of its key
    by the task that it comes from; the last level joins FEW rows a key at most.
    """
    at = F.spark_partition_id()
    parts = parts.withColumn("in_slice", at)
    for level in range(levels - 1, 0, -1):
        parts = parts.withColumn("in_slice", F.pmod(F.col("in_slice"), F.lit(FEW**level)))

        def joined(table: pa.Table) -> pa.Table:
            slice_of = table.column("in_slice")[:1]
            return join(table.drop_columns(["in_slice"])).append_column("in_slice", slice_of)

        parts = parts.groupBy(key, "in_slice").applyInArrow(joined, f"{schema}, in_slice int")
    return parts.drop("in_slice").groupBy(key).applyInArrow(join, schema)


def buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    """Even buckets 0 to n-1 for hashed values."""
    return ((mix(values) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split_by(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Yields (bucket, its part of each column)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = [np.split(c[order], cuts) for c in columns]
    for k, b in enumerate(bucket[np.concatenate([[0], cuts])] if len(bucket) else []):
        yield int(b), *(p[k] for p in parts)


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Packs dict rows into record batches."""
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text: rows that share it are copies in both."""
    marked = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(marked[0], F.lit("\0"), marked[1]).cast("binary")))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. decided: key, kept for every row; of rows with equal keys one stays at most.

    Rows whose key no dropped row has, nearly all, are passed on where they are; the others alone are joined. Which are
    which is told by a Bloom filter of bounded size.
    """
    dropped = materialise(decided.filter(~F.col("kept")).select(F.xxhash64("key").alias("key")), "dropped")
    n = rows_of(dropped)
    if n == 0:
        discard(dropped)
        return docs
    bits = build_bloom(dropped, "key", n).bits
    discard(dropped)
    key, doubt = fresh(docs, "row_key", "row_doubt")

    def doubtful(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bloom = Bloom(bits)
        for k in keys:
            yield pd.Series(bloom.has(k.to_numpy().astype(np.int64).view(np.uint64)), dtype="bool")

    doubtful.__annotations__ = {"keys": Iterator[pd.Series], "return": Iterator[pd.Series]}
    marked = docs.withColumn(key, row_key(id_col, text_col))
    marked = marked.withColumn(doubt, F.pandas_udf(doubtful, "boolean")(F.xxhash64(key)))
    kept = decided.filter("kept").select(F.col("key").alias(key)).distinct()
    some = marked.filter(F.col(doubt)).join(kept, key, "left_semi").dropDuplicates([key])
    every = marked.filter(~F.col(doubt)).unionByName(some)
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, members: str, n: int, how: str = "left") -> DataFrame:
    """Joins rows with one row a group, whatever share of the rows a group holds.

    Groups of over n/1000 (and 500) members number 1,000 at most by arithmetic, so they are broadcast;
    no key of the shuffled rest is hot.
    """
    hot = F.col(members) > max(500, n // 1000)
    few = groups.filter(hot)
    if rows_of(few) == 0:
        return rows.join(groups, key, how)
    marked = rows.join(F.broadcast(few.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    extra = [c for c in groups.columns if c != key]
    first = marked.filter("_hot is not null").drop("_hot").join(F.broadcast(few), key)
    rest = marked.filter("_hot is null").drop("_hot").join(groups.filter(~hot), key, how)
    return first.select(*rows.columns, *extra).unionByName(rest.select(*rows.columns, *extra))
