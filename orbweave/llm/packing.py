"""Operator 3: packing token sequences by best-fit decreasing.

A document's ids, each document ending in an end id, are cut into full windows; what remains, shorter than a
window, goes with other remainders into the tightest open window that it fits. A segment tree indexed by
remaining capacity finds that window in log2(window) steps. Remainders are dealt into groups of a few
thousand, evenly by hash, and each group is packed on its own: no task holds more than that, and what
doesn't fit costs a fraction of a window a group. Full windows are never moved.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are separate documents; null
ids stay null; an empty table gives no rows; other columns aren't read. Special tokens' strings in a text get the
tokenizer's ids.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import as_bytes, materialise, rows_of, tidy, words

WINDOW, END_ID = 2048, 1
#: Remainders packed together.
GROUP = 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The tokenizer's pieces of a word, and the characters for which these patterns and its own might differ.
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_ODD = re.compile("[\x00-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]|<\\|")


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts whose tokenizer never joins across white space, word by word, from bounded memos.

    New words of Latin letters are cut into the tokenizer's pieces and merged by its model; all others go through the
    whole tokenizer. A memo is emptied when it holds `limit` entries.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge, self.names = self.tokenizer.model.tokenize, byte_names()
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if _ODD.search(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for piece in _PIECES.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
                ids = self.pieces[piece] = b"".join(t.id.to_bytes(4, "little") for t in self.merge(named))
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes | str | None]) -> list[np.ndarray]:
        split = list(map(words, texts))
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        for w in {w for ws in split for w in ws if w not in memo}:
            memo[w] = self.word(w.decode("utf-8", "replace"))
        return [np.frombuffer(b"".join(map(memo.__getitem__, ws)), "<u4") for ws in split]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, whatever number of tasks it runs."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: full windows, then the remainder if there is one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], "<u4")
        for b in batches:
            ids_of, texts = b.column(0).cast(pa.int64()).to_pylist(), b.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for k in range(0, len(texts), 256):
                for doc, ids in zip(ids_of[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        for column, value in zip(rows, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long"), as_bytes(text_col)).mapInArrow(run, _PIECE)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves hold stacks of windows."""

    def __init__(self, window: int):
        self.size = 1 << (window - 1).bit_length() if window > 1 else 1
        self.size = self.size if self.size > window else 2 * self.size
        self.count = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}

    def put(self, capacity: int, which: int) -> None:
        self.stacks.setdefault(capacity, []).append(which)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with at least `length` left, removed; None if there is none."""
        count, node = self.count, length + self.size
        if not count[node]:
            # up to the first right neighbour that holds a window, then down to its least capacity
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        which = self.stacks[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece, longest first; ties keep their order."""
    tree = OpenWindows(window)
    which, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        capacity, w = tree.take(n) or (window, made)
        made += w == made
        which[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.put(capacity - n, w)
    return which, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    cut = materialise(pieces(docs, path or tokenizer_path(), window, end_id, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()), "packing")
    full, short = cut.filter(F.col("length") == window), cut.filter(F.col("length") < window)
    groups = max(1, -(-rows_of(short) // group))
    kind = f"{_PIECE}, sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("piece", "ascending")])
        which, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        g = table.column("g")[0].as_py()
        out = table.select(_SCHEMA.names)
        # odd numbers are windows of remainders, even ones full windows
        return out.append_column("sequence_id", pa.array(2 * ((g << 32) + which) + 1, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = short.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(run, kind)
    return full.select(*_SCHEMA.names, (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(packed)
