"""Operator 1: scoring texts with a hidden Markov language model.

Latent states emit words; states and emissions are trained by Baum-Welch, whose expected counts are summed in each
partition and then across partitions; a text's probability is the scaled forward recursion over all its words and
the end, exactly.

The vocabulary is as large as the corpus makes it, so states emit a bounded alphabet: the HOT most frequent
words, the end, and CLASSES spelling classes of all other words. A rarer word's probability is its class's, as the state emits it,
times its own within the class, (count + 1) / (tokens + words + 1), an exact model with tied emissions. Hot words are broadcast
(bounded by HOT); the counts of rare words stay distributed: their occurrences travel, as hashes, to the bucket
that holds their counts. A rare word isn't a hot key, as all hot keys are in the alphabet.

Counts, contexts and expected counts cover all training texts. Texts are read twice, once to count words and once to
encode them in the shared folder; every later pass reads the codes. For training, texts are cut into parts of about
SEGMENT codes that overlap by one, so that every move and code counts once; scores run over whole texts.

Defined cases: null and empty texts are the end alone; a null id is in training; repeated rows count twice and score alike;
an empty table gives no rows; without any training text N and V are 0; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Hashes, as_bytes, buckets_of, in_levels, lower_words, materialise, split_by, tidy

HOT, CLASSES, STATES, ROUNDS = 1 << 17, 256, 8, 3
#: Words whose neighbours start the states, and the neighbours looked at.
SEEDS, CONTEXT = 4096, 48
BUCKET, PART = 1 << 21, 1 << 12
#: The prior's tokens for each word, codes of a segment, and codes of a padded group.
PRIOR, SEGMENT, AREA = 3.0, 256, 400_000
#: Held-out texts: crc32(doc_id as text) mod FOLDS is FOLD.
FOLDS, FOLD = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == FOLD


_BEYOND = re.compile(rb"[\x80-\xff]{1,2}")


def spelling(word: bytes) -> int:
    """A class of rare words: by their first bytes beyond ASCII and their last two."""
    odd = _BEYOND.search(word)
    return xxhash.xxh32_intdigest((odd[0] if odd else b"") + word[-2:]) % CLASSES


def sum_parts(df: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Adds arrays (part, blob) of the same part; there are few parts, whatever the input, and few blobs in a group."""

    def add(table: pa.Table) -> pa.Table:
        total = np.frombuffer(table.column("blob")[0].as_buffer(), dtype).copy()
        for x in table.column("blob")[1:]:
            total += np.frombuffer(x.as_buffer(), dtype)
        return pa.table({"part": table.column("part")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    return {r.part: np.frombuffer(r.blob, dtype) for r in in_levels(df, "part", add, "part long, blob binary").collect()}


def _parts(values: np.ndarray) -> pa.RecordBatch:
    """An array in parts of PART rows; parts of zeros are left out."""
    keep = [k for k in range(0, len(values), PART) if values[k : k + PART].any()]
    return pa.RecordBatch.from_arrays([pa.array([k // PART for k in keep], pa.int64()), pa.array([values[k : k + PART].tobytes() for k in keep], pa.binary())], ["part", "blob"])


def _join_parts(parts: dict[int, np.ndarray], rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width))
    for k, v in parts.items():
        out[k * PART : (k + 1) * PART] = v.reshape(-1, width)
    return out


_COUNTS = np.dtype([("h", "<u8"), ("c", "<i8"), ("s", "<u2")])


def count_words(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: sorted hashes of the words with counts and spelling classes; all words of all texts given."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for v in b.column(0):
                for w in lower_words(v.as_py()):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 500_000:
                    yield from out(counts)
                    counts = {}
        yield from out(counts)

    def out(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(len(counts), _COUNTS)
        rows["h"] = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts))
        rows["c"] = np.fromiter(counts.values(), np.int64, len(counts))
        rows["s"] = np.fromiter(map(spelling, counts), np.uint16, len(counts))
        parts = list(split_by(buckets_of(rows["h"], buckets), rows))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["bucket", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _COUNTS) for x in table.column("blob").to_pylist()])
        rows = rows[np.argsort(rows["h"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
        total = rows[first].copy()
        total["c"] = np.add.reduceat(rows["c"], first)
        return pa.table({"bucket": table.column("bucket")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "bucket long, blob binary").groupBy("bucket").applyInArrow(merge, "bucket long, blob binary")


def level_of(counts: np.ndarray) -> np.ndarray:
    """A count's level, 1 to 4160: exact up to 64, then 64 levels for each doubling."""
    c = np.maximum(counts.astype(np.int64), 1)
    power = np.maximum(np.floor(np.log2(c)).astype(np.int64) - 6, 0)
    return (c >> power) + power * 64


class Alphabet:
    """Codes: hot words by falling count, then spelling classes, then the end."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray, train_docs: int, tokens: int, types: int):
        self.hot, self.counts, self.end_count = hot, counts, train_docs
        self.n, self.v = tokens + train_docs, types + (train_docs > 0)
        self.first_class, self.end = len(hot), len(hot) + CLASSES
        self.size = self.end + 1
        self.class_tokens = self.class_types = np.zeros(CLASSES)


def alphabet(vocabulary: DataFrame, train_docs: int, hot: int) -> Alphabet:
    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("blob"):
                levels, n = np.unique(level_of(np.frombuffer(x.as_py(), _COUNTS)["c"]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(levels), pa.array(n)], ["level", "n"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("blob"):
                rows = np.frombuffer(x.as_py(), _COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array([int(rows["c"].sum())]), pa.array([len(rows)])], ["tokens", "types"])

    sums = vocabulary.mapInArrow(totals, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    # the lowest level of counts above which there are `hot` words at most: no sort, and no task that gathers candidates
    cut, room = 0, hot
    for r in sorted(vocabulary.mapInArrow(spread, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.level):
        room -= r.n
        if room < 0:
            cut = r.level
            break

    @tidy
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("blob"):
                rows = np.frombuffer(x.as_py(), _COUNTS)
                rows = rows[level_of(rows["c"]) > cut]
                yield pa.RecordBatch.from_arrays([pa.array(rows["h"].copy().view(np.int64)), pa.array(rows["c"].copy())], ["h", "c"])

    best = vocabulary.mapInArrow(top, "h long, c long").toArrow()
    h, c = best.column("h").to_numpy(), best.column("c").to_numpy()
    order = np.lexsort((h, -c))
    made = Alphabet(h[order].view(np.uint64), c[order], train_docs, sums[0] or 0, sums[1] or 0)
    known = np.sort(made.hot)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 2))
        for b in batches:
            for x in b.column("blob"):
                rows = np.frombuffer(x.as_py(), _COUNTS)
                rows = rows[~np.isin(rows["h"], known)]
                total[:, 0] += np.bincount(rows["s"], rows["c"], CLASSES)
                total[:, 1] += np.bincount(rows["s"], minlength=CLASSES)
        yield _parts(total)

    classes = _join_parts(sum_parts(vocabulary.mapInArrow(rest, "part long, blob binary"), "<f8"), CLASSES, 2)
    made.class_tokens, made.class_types = classes[:, 0], classes[:, 1]
    return made


class Codes(dict):
    """Word to code, bounded; a rare word's code is its class."""

    def __init__(self, hot: dict[int, int], first_class: int, limit: int = 400_000):
        super().__init__()
        self.hot, self.first_class, self.limit = hot, first_class, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        code = self.hot.get(h)
        code = self[word] = self.first_class + spelling(word) if code is None else code
        return code


def encode(docs: DataFrame, alpha: Alphabet, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, codes and the hashes of the rare words, as binary columns."""
    hot_words, first, end = alpha.hot, alpha.first_class, alpha.end
    names = ["doc_id", "held_out", "codes", "rare"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of, hashes = Codes({int(h): i for i, h in enumerate(hot_words)}, first), Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                codes, rare = [], []
                for v in part.column(2):
                    tokens = lower_words(v.as_py())
                    c = np.fromiter(map(codes_of.__getitem__, tokens), np.uint32, len(tokens))
                    rare.append(hashes.array([tokens[i] for i in np.flatnonzero(c >= first).tolist()]).tobytes())
                    codes.append(np.append(c, np.uint32(end)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.binary()), pa.array(rare, pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), as_bytes(text_col))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, codes binary, rare binary").withColumn("rid", F.monotonically_increasing_id())


def _sequences(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Codes of documents, about `most` codes at a time."""
    held, n = [], 0
    for b in batches:
        for v in b.column("codes"):
            held.append(np.frombuffer(v.as_buffer(), np.uint32))
            n += len(held[-1])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def context_counts(encoded: DataFrame, alpha: Alphabet) -> np.ndarray:
    """How often each of the SEEDS most frequent words has each of the CONTEXT most frequent before and after it."""
    seeds = min(SEEDS, len(alpha.hot))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((seeds, 2 * CONTEXT))
        for docs in _sequences(batches, 1_000_000):
            a, b = np.concatenate([d[:-1] for d in docs]).astype(np.int64), np.concatenate([d[1:] for d in docs]).astype(np.int64)
            for x, y, shift in ((a, b, 0), (b, a, CONTEXT)):
                ok = (x < seeds) & (y < CONTEXT)
                total += np.bincount(x[ok] * 2 * CONTEXT + y[ok] + shift, minlength=total.size).reshape(total.shape)
        yield _parts(total)

    return _join_parts(sum_parts(encoded.select("codes").mapInArrow(run, "part long, blob binary"), "<f8"), seeds, 2 * CONTEXT)


def cluster(contexts: np.ndarray, weights: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """k-means on the square roots of context shares, from the farthest points on; no randomness."""
    x = np.sqrt(contexts / np.maximum(contexts.sum(1, keepdims=True), 1))
    centres = x[:1]
    while len(centres) < k:
        gap = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1) * np.log1p(weights)
        centres = np.concatenate([centres, x[[int(gap.argmax())]]])
    for _ in range(rounds):
        of = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for j in range(k):
            if (of == j).any():
                centres[j] = np.average(x[of == j], 0, weights[of == j] + 1e-9)
    return of


class Model:
    """start (K), move (K, K), emit (alphabet, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def masses(alpha: Alphabet) -> np.ndarray:
    """Shares of the codes, each word and class with one more than counted."""
    m = np.concatenate([alpha.counts + 1.0, alpha.class_tokens + alpha.class_types + 1.0, [alpha.end_count + 1.0]])
    return m / m.sum()


def first_model(alpha: Alphabet, contexts: np.ndarray, k: int) -> Model:
    share = masses(alpha)
    lean = np.full((alpha.size, k), 1.0 / k)
    if len(contexts) > k:
        of = cluster(contexts, alpha.counts[: len(contexts)].astype(float), k)
        lean[: len(of)] = 0.2 / k
        lean[np.arange(len(of)), of] += 0.8
    emit = share[:, None] * lean
    return Model(np.full(k, 1 / k), np.full((k, k), 0.4 / k) + 0.6 * np.eye(k), emit / emit.sum(0))


def bounded(lengths: np.ndarray, area: int = AREA) -> Iterator[np.ndarray]:
    """Numbers of the sequences from the longest on, in groups whose padded area (of SEGMENT codes a sequence at most) is bounded."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, area // min(int(lengths[order[at]]), SEGMENT))
        yield order[at : at + n]
        at += n


def cut(docs: list[np.ndarray]) -> list[tuple[np.ndarray, bool]]:
    """Parts of SEGMENT codes at most, each from the last code of the one before, and whether it begins a text."""
    return [(d[i : i + SEGMENT], i == 0) for d in docs for i in range(0, max(1, len(d) - 1), SEGMENT - 1)]


def expected_counts(docs: list[np.ndarray], model: Model, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected starts, moves and emissions over sequences, and their log-likelihood.

    first: which begin a text (all by default). The others begin at the code that their predecessor ends with: the move from it is
    theirs, the code itself isn't counted again, and the states there are the model's in the long run.
    """
    k = len(model.start)
    start, move, emit, fit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k)), 0.0
    first = np.ones(len(docs), bool) if first is None else first
    for part in bounded(np.array([len(d) for d in docs])):
        s, m, e, f = _expected([docs[i] for i in part], model, first[part])
        start, move, fit = start + s, move + m, fit + f
        emit += e
    return start, move, emit, fit


def _expected(docs: list[np.ndarray], model: Model, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """expected_counts() of sequences by falling length.

    Only the states at each segment's start are kept from the way there; on the way back a segment is run again,
    so that memory is bounded by a segment's area.
    """
    lengths = np.array([len(d) for d in docs])
    k, n, longest = len(model.start), len(docs), int(lengths[0])
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    flat = np.concatenate(docs).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right").tolist()
    long_run = np.linalg.matrix_power(model.move, 64)[0]
    now, before = np.where(first[:, None], model.start, long_run).astype(np.float32), []
    for t in range((longest - 1) // SEGMENT * SEGMENT + 1):
        m = active[t]
        if t % SEGMENT == 0:
            before.append(now[:m].copy())
        if t < (longest - 1) // SEGMENT * SEGMENT:
            now = (now if t == 0 else now[:m] @ move) * emit[flat[starts[:m] + t]]
            now /= now.sum(1, keepdims=True)
    back = np.ones((n, k), np.float32)
    moved, emitted, fit, started = np.zeros((k, k)), np.zeros((len(emit), k)), 0.0, np.zeros(k)
    for a in range((longest - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
        b, prior = min(a + SEGMENT, longest), before.pop()
        alpha, scale = np.zeros((b - a, len(prior), k), np.float32), np.ones((b - a, len(prior)), np.float32)
        codes = np.zeros((b - a, len(prior)), np.int64)
        now = prior
        for t in range(a, b):
            m = active[t]
            codes[t - a, :m] = flat[starts[:m] + t]
            now = (now if t == 0 else now[:m] @ move) * emit[codes[t - a, :m]]
            scale[t - a, :m] = now.sum(1)
            now /= scale[t - a, :m, None]
            alpha[t - a, :m] = now
        for t in range(b - 1, a - 1, -1):
            m = active[t]
            alpha_back = emit[codes[t - a, :m]] * back[:m] / scale[t - a, :m, None]
            if t > 0:
                moved += (alpha[t - a - 1, :m] if t > a else prior[:m]).T @ alpha_back
            alpha[t - a, :m] *= back[:m]  # is the posterior from here on
            back[:m] = alpha_back @ move.T
        of = np.arange(len(prior))[None, :] < np.array(active[a:b])[:, None]
        if a == 0:
            of[0] &= first
        post = alpha[of]
        emitted += np.stack([np.bincount(codes[of], post[:, j], len(emit)) for j in range(k)], 1)
        fit += float(np.log(scale[of]).sum())
        if a == 0:
            started = alpha[0][first].sum(0)
    return started, moved * model.move, emitted, fit


def train_round(encoded: DataFrame, model: Model, share: np.ndarray, prior: float = PRIOR) -> tuple[Model, float]:
    """One round of Baum-Welch over all training texts, with tied emissions.

    A word's probability in a state is its share of the corpus times P(state | word) / P(state). The M-step is the maximum,
    for P(state | word), of the expected emissions under a Dirichlet prior of `prior` tokens spread as all tokens are; shares
    are held at the corpus's. Free emissions with a prior of their own were worse on held-out texts (-3.87 log10 a token
    against -3.79), as words seen once are bound to the states that they happened to fall in.
    """
    k, size = len(model.start), len(model.emit)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + k + 2, k))
        for docs in _sequences(batches, 400_000):
            parts = cut(docs)
            started, moved, emitted, fit = expected_counts([p for p, _ in parts], model, np.array([f for _, f in parts]))
            total[:size] += emitted
            total[size : size + k] += moved
            total[size + k] += started
            total[size + k + 1, 0] += fit
        yield _parts(total.astype(np.float32))

    total = _join_parts(sum_parts(encoded.select("codes").mapInArrow(run, "part long, blob binary"), "<f4"), size + k + 2, k)
    seen = total[:size]
    split = (seen + prior * seen.sum(0) / max(seen.sum(), 1e-9)) / (seen.sum(1, keepdims=True) + prior)
    emit = share[:, None] * split
    move = total[size : size + k] + 1.0
    start = total[size + k] + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / np.maximum(emit.sum(0), 1e-300)), total[-1, 0]


def forward(docs: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    lengths = np.array([len(docs[i]) for i in order])
    flat = np.concatenate([docs[i] for i in order])
    starts = np.cumsum(lengths) - lengths
    now, total = model.start, np.zeros(len(docs))
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t in range(int(lengths[0])):
        m = active[t]
        now = (now if t == 0 else now[:m] @ model.move) * model.emit[flat[starts[:m] + t]]
        s = now.sum(1)
        now /= s[:, None]
        total[:m] += np.log(s)
    out = np.zeros(len(docs))
    out[order] = total
    return out


def rare_sums(encoded: DataFrame, vocabulary: DataFrame, buckets: int) -> DataFrame:
    """rid, rare_log, rare_known: over a document's rare words, the sum of log10(count + 1), and how many have a count."""
    kind = np.dtype([("h", "<u8"), ("rid", "<i8")])

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for rid, rare in zip(b.column("rid").to_pylist(), b.column("rare").to_pylist(), strict=True):
                rows = np.zeros(len(rare) // 8, kind)
                rows["h"], rows["rid"] = np.frombuffer(rare, np.uint64), rid
                held.append(rows)
                n += len(rows)
                if n > 500_000:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        parts = list(split_by(buckets_of(rows["h"], buckets), rows))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary()), pa.array([False] * len(parts))], ["bucket", "blob", "counts"])

    found = np.dtype([("rid", "<i8"), ("log", "<f8"), ("known", "<i8")])

    def look(table: pa.Table) -> pa.Table:
        """One blob for each group of documents, not a row for each document."""
        counts = table.column("counts").to_pylist()
        blobs = table.column("blob").to_pylist()
        known = np.concatenate([np.zeros(0, _COUNTS), *(np.frombuffer(x, _COUNTS) for x, c in zip(blobs, counts, strict=True) if c)])
        rows = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x, c in zip(blobs, counts, strict=True) if not c)])
        c = np.zeros(len(rows))
        if len(known):
            at = np.minimum(np.searchsorted(known["h"], rows["h"]), len(known) - 1)
            c = np.where(known["h"][at] == rows["h"], known["c"][at], 0)
        rids, of = np.unique(rows["rid"], return_inverse=True)
        out = np.zeros(len(rids), found)
        out["rid"], out["log"], out["known"] = rids, np.bincount(of, np.log10(c + 1.0), len(rids)), np.bincount(of, c > 0, len(rids))
        parts = list(split_by(buckets_of(rids.view(np.uint64), buckets), out))
        return pa.table({"docs": pa.array([k for k, _ in parts], pa.int64()), "sums": pa.array([x.tobytes() for _, x in parts], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, found) for x in table.column("sums").to_pylist()])
        rids, of = np.unique(rows["rid"], return_inverse=True)
        return pa.table({"rid": rids, "rare_log": np.bincount(of, rows["log"], len(rids)), "rare_known": np.bincount(of, rows["known"], len(rids)).astype(np.int64)})

    sent = encoded.select("rid", "rare").mapInArrow(send, "bucket long, blob binary, counts boolean")
    both = sent.unionByName(vocabulary.select("bucket", "blob", F.lit(True).alias("counts")))
    sums = both.groupBy("bucket").applyInArrow(look, "docs long, sums binary")
    return sums.groupBy("docs").applyInArrow(gather, "rid long, rare_log double, rare_known long")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, Alphabet, DataFrame, DataFrame, int, list[float]]:
    """(model, alphabet, encoded texts, vocabulary, buckets, log-likelihood before each round)."""
    training = docs.filter(~held_out(F.col(id_col)))
    sums = training.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    buckets = max(1, (sums[1] or 0) // 6 // (4 * BUCKET))
    vocabulary = materialise(count_words(training.select(as_bytes(text_col)), buckets), "hmm-words")
    alpha = alphabet(vocabulary, sums[0], hot)
    encoded = materialise(encode(docs, alpha, id_col, text_col), "hmm-codes")
    learnt = encoded.filter("not held_out")
    model, fits = first_model(alpha, context_counts(learnt, alpha), states), []
    for _ in range(rounds):
        model, fit = train_round(learnt, model, masses(alpha))
        fits.append(fit)
    return model, alpha, encoded, vocabulary, buckets, fits


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    model, alpha, encoded, vocabulary, buckets, _ = train(docs, id_col, text_col, hot, states, rounds)
    n, v, first, end = alpha.n, alpha.v, alpha.first_class, alpha.end
    base = np.concatenate([np.log10(alpha.counts + 1.0), np.zeros(CLASSES), [np.log10(alpha.end_count + 1.0)]]) - np.log10(n + v + 1)
    inside = np.zeros(alpha.size)
    inside[first:end] = -np.log10(alpha.class_tokens + alpha.class_types + 1)
    known = np.concatenate([np.ones(first), np.zeros(CLASSES), [alpha.end_count > 0]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 5000):
                part = b.slice(k, 5000)
                docs = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("codes")]
                starts = np.cumsum([0, *map(len, docs)])[:-1]
                flat = np.concatenate(docs)
                add = lambda values: np.add.reduceat(values[flat], starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array([len(d) for d in docs], pa.int64()), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(forward(docs, model) / np.log(10) + add(inside))],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "fit"],
                )

    scored = encoded.select("rid", "doc_id", "held_out", "codes").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, fit double")
    joined = scored.join(rare_sums(encoded, vocabulary, buckets), "rid", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rare).alias("base_score"),
        (F.col("fit") + rare).alias("score"),
    )
