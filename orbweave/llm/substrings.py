"""Operator 9: substring deduplication with difference-cover anchors.

A window is a fixed number of consecutive words. A word goes if a window that covers it starts anywhere else
too, in the same document or another.

Only windows at cover positions are hashed first: positions whose remainder modulo a period lies in a
difference cover. For any two places where a window starts there is a shift below the period that puts both on
cover positions, so two equal windows share an anchor, a shorter run inside both at that shift. Anchors that
occur once are dropped; a document's windows that hold a repeated anchor at a cover position are the
candidates. These are extended: the whole window is hashed (96 bits) and counted, exactly and over all
documents. Candidate pairs are never formed; hashes are counted in buckets of about a million, whatever
number of places a window has.

The anchors that repeat are told to the tasks by a Bloom filter of bounded size; false positives are only candidates
that the count refutes.

Defined cases: a null text has no words and the SHA-256 of the empty string; texts shorter than a window lose
nothing; repeated rows repeat each other's windows; null ids are kept; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Bloom, Hashes, as_bytes, buckets_of, build_bloom, materialise, mix, rows_of, split_by, tidy, window_hashes, words

WINDOW = 35
#: Every difference modulo PERIOD is a difference of two members of COVER (a perfect difference set).
PERIOD, COVER = 13, (0, 1, 3, 9)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
#: Hashes in a bucket, about.
BUCKET = 1 << 20


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _flat(texts: list[bytes | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in a row, and where each text starts (one more at the end)."""
    split = list(map(words, texts))
    starts = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)]).astype(np.int64)
    return hashes.array(list(chain.from_iterable(split))), starts


def _inside(starts: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n window starts lie in one text, and each word's place in its text."""
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(of)) - starts[of]
    left = starts[of + 1] - np.arange(len(of))
    return left[:n] >= length, place


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[tuple[list, list]]:
    """Rows of (key column, texts), a bounded number at a time."""
    for b in batches:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def anchors(docs: DataFrame, text_col: str, window: int, buckets: int) -> DataFrame:
    """bucket, hashes: the anchors of all documents, a blob for each bucket and a few hundred documents."""
    length = window - PERIOD + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: list[np.ndarray] = []
        for _, texts in _chunks(batches):
            h, starts = _flat(texts, hashes)
            runs = window_hashes(h, length)
            fits, place = _inside(starts, length, len(runs))
            held.append(runs[fits & _ON_COVER[place[: len(runs)] % PERIOD]])
            if sum(map(len, held)) > 2_000_000:
                yield from out(held)
                held = []
        yield from out(held)

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # what occurs twice here is sent twice and no oftener
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        third = np.concatenate([[False, False], values[2:] == values[:-2]]) if len(values) > 2 else np.zeros(len(values), bool)
        values = values[~third]
        parts = list(split_by(buckets_of(values, buckets), values))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([v.tobytes() for _, v in parts], pa.binary())], ["bucket", "hashes"])

    return docs.select(F.lit(0).alias("k"), as_bytes(text_col)).mapInArrow(run, "bucket long, hashes binary")


def repeated_anchors(blobs: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]))
        same = values[1:] == values[:-1]
        return pa.table({"anchor": np.unique(values[1:][same]).view(np.int64)})

    return blobs.groupBy("bucket").applyInArrow(run, "anchor long")


def _key(doc: int | None, text: bytes | None) -> int:
    """A document's key: rows with equal id and text share it, and lose the same words."""
    return xxhash.xxh3_64_intdigest(text or b"", (doc or 0) & ((1 << 64) - 1)) >> 1


def candidate_windows(docs: DataFrame, bloom: Bloom, id_col: str, text_col: str, window: int, buckets: int) -> DataFrame:
    """bucket, blob: (hash, more hash, key, start) of windows that hold a perhaps repeated anchor; bucket, found: (key, start) of repeats.

    Of windows that are the same among about a million, which are repeats wherever else they are, one alone goes on to meet
    others of its hash, so that a window of any frequency is a row for each million.
    """
    length, bits = window - PERIOD + 1, bloom.bits

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filt, held = Hashes(), Bloom(bits), []
        for ids, texts in _chunks(batches):
            h, starts = _flat(texts, hashes)
            n = len(h) - window + 1
            if n <= 0:
                continue
            runs = window_hashes(h, length)
            fits, place = _inside(starts, length, len(runs))
            at = np.flatnonzero(fits & _ON_COVER[place[: len(runs)] % PERIOD])
            hit = np.zeros(len(h) + 1, np.int64)
            hit[at[filt.has(runs[at])] + 1] = 1
            seen = np.cumsum(hit)  # repeated anchors before each place
            whole, _ = _inside(starts, window, n)
            near = np.flatnonzero(whole & (seen[np.arange(n) + PERIOD] > seen[:n]))
            if not len(near):
                continue
            of = np.searchsorted(starts, near, side="right") - 1
            keys = np.array([_key(*x) for x in zip(ids, texts, strict=True)], np.uint64)
            rows = np.zeros(len(near), _WINDOW_ROW)
            rows["h"] = window_hashes(h, window)[near]
            rows["g"] = window_hashes(mix(h ^ np.uint64(0xA0761D6478BD642F)), window)[near] & np.uint64(0xFFFFFFFF)
            rows["at"], rows["key"] = near - starts[of], keys[of]
            held.append(rows)
            if sum(map(len, held)) > 1_000_000:
                yield from out(held)
                held = []
        yield from out(held)

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["g"], rows["h"]))]
            same = (rows["h"][1:] == rows["h"][:-1]) & (rows["g"][1:] == rows["g"][:-1])
            again = np.concatenate([[False], same])
            repeats = _marks(rows[again | np.concatenate([same, [False]])])
            rows = rows[~again]
            parts = list(split_by(buckets_of(rows["h"], buckets), rows))
            known = list(split_by(buckets_of(repeats["key"], buckets), repeats))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in parts + known], pa.int64()),
                    pa.array([v.tobytes() for _, v in parts] + [None] * len(known), pa.binary()),
                    pa.array([None] * len(parts) + [v.tobytes() for _, v in known], pa.binary()),
                ],
                ["bucket", "blob", "found"],
            )

    return docs.select(F.col(id_col).cast("long"), as_bytes(text_col)).mapInArrow(run, "bucket long, blob binary, found binary")


_WINDOW_ROW = np.dtype([("h", "<u8"), ("g", "<u4"), ("at", "<u4"), ("key", "<u8")])
_MARK = np.dtype([("key", "<u8"), ("at", "<u4")])


def _marks(rows: np.ndarray) -> np.ndarray:
    found = np.zeros(len(rows), _MARK)
    found["key"], found["at"] = rows["key"], rows["at"]
    return found


def repeated_windows(blobs: DataFrame, groups: int) -> DataFrame:
    """key, starts: where the repeated windows of each document start (32-bit numbers), a row for each document that has any.

    A bucket of hashes sends what it found as one blob for each group of keys, not a row for each document.
    """

    def find(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.zeros(0, _WINDOW_ROW), *(np.frombuffer(x, _WINDOW_ROW) for x in table.column("blob").to_pylist() if x)])
        rows = rows[np.lexsort((rows["g"], rows["h"]))]
        same = (rows["h"][1:] == rows["h"][:-1]) & (rows["g"][1:] == rows["g"][:-1])
        rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(rows) > 1 else rows[:0]
        found = np.concatenate([_marks(rows), *(np.frombuffer(x, _MARK) for x in table.column("found").to_pylist() if x)])
        parts = list(split_by(buckets_of(found["key"], groups), found))
        return pa.table({"keys": pa.array([k for k, _ in parts], pa.int64()), "found": pa.array([x.tobytes() for _, x in parts], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _MARK) for x in table.column("found").to_pylist()])
        rows = rows[np.lexsort((rows["at"], rows["key"]))]
        rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["at"][1:] != rows["at"][:-1])])]
        keys, first = np.unique(rows["key"], return_index=True)
        at = np.split(np.ascontiguousarray(rows["at"]), first[1:]) if len(keys) else []
        return pa.table({"key": pa.array(keys.view(np.int64)), "starts": pa.array([a.tobytes() for a in at], pa.binary())})

    found = blobs.groupBy("bucket").applyInArrow(find, "keys long, found binary")
    return found.groupBy("keys").applyInArrow(gather, "key long, starts binary")


def kept_words(split: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    if not len(starts):
        return split
    edge = np.zeros(len(split) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [w for w, gone in zip(split, covered, strict=True) if not gone]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the text without repeated passages, for every row."""
    if window <= PERIOD or not covers(PERIOD, COVER):
        raise ValueError(f"a window must be longer than {PERIOD} words")
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, total // 6 * len(COVER) // PERIOD // BUCKET)
    again = materialise(repeated_anchors(anchors(docs, text_col, window, buckets)), "anchors")
    bloom = build_bloom(again, "anchor", rows_of(again))
    found = repeated_windows(candidate_windows(docs, bloom, id_col, text_col, window, buckets), buckets)
    marks = materialise(found, "repeats")
    marked = build_bloom(marks, "key", rows_of(marks)).bits

    def finish(split: list[bytes], starts: bytes | None) -> list[bytes]:
        return kept_words(split, np.frombuffer(starts or b"", "<u4").astype(np.int64), window)

    schema = "doc_id long, n_words long, n_removed long, kept binary"

    @tidy
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without marks are done where they are; the others' texts travel to their marks."""
        filt = Bloom(marked)
        for ids, texts in _chunks(batches):
            keys = np.array([_key(*x) for x in zip(ids, texts, strict=True)], np.uint64)
            some = filt.has(keys)
            split = [[] if m else words(t) for t, m in zip(texts, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([None if m else len(w) for w, m in zip(split, some, strict=True)], pa.int64()),
                    pa.array([(t or b"") if m else b" ".join(w) for t, w, m in zip(texts, split, some, strict=True)], pa.binary()),
                    pa.array(keys.view(np.int64)),
                ],
                ["doc_id", "n_words", "text", "key"],
            )

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, n, text, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_words", "text", "starts")), strict=True):
                if n is None:
                    split = words(text)
                    kept = finish(split, starts)
                    row = (doc, len(split), len(split) - len(kept), b" ".join(kept))
                else:
                    row = (doc, n, 0, text)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    rows = materialise(docs.select(F.col(id_col).cast("long"), as_bytes(text_col)).mapInArrow(clean, "doc_id long, n_words long, text binary, key long"), "repeats-rows")
    done = rows.filter("n_words is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    travel = rows.filter("n_words is null").join(marks, "key", "left").select("doc_id", "n_words", "text", "starts")
    return done.unionByName(travel.mapInArrow(cut, schema)).withColumn("kept", F.col("kept").cast("string"))


def kept_digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
