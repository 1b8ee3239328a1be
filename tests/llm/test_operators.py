"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import exactdedup, hmm, html, jaccard, media, mixing, packing, quality, sharding, substrings
from orbweave.llm.common import Bloom, build_bloom, window_hashes
from orbweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, `node` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    """Documents with copies, near copies, shared passages, nulls, empties, a repeated row and a hot source; clashing columns besides."""
    r = random.Random(seed)
    say = lambda k: " ".join("".join(r.choice("abcdeéXY,.") for _ in range(r.randint(1, 6))) for _ in range(k))
    passage, base = say(45), say(120)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = base.split()
            words[r.randrange(len(words))] = "edit%d" % i
            text = " ".join(words)
        elif kind == 1:
            text = say(r.randint(0, 30)) + "\n" + passage + "\t" + say(r.randint(0, 30))
        elif kind == 2:
            text = base.replace(" ", "  ") if i % 4 else base
        else:
            text = say(r.randint(1, 150))
        rows.append([i, text, "en", ["big", "big", None, "s%d" % (i % 5)][i % 4], len(text), 7, "x"])
    rows[3][1], rows[4][1], rows[5][1], rows[9][1] = None, "", " \n\t", say(5000)
    rows.append(list(rows[0]))
    rows.append([n + 1, None, None, None, None, None, None])
    return [tuple(x) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_window_hashes_depend_on_the_words_alone():
    h = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    for length in (1, 4, 8, 9, 23, 35):
        twice = window_hashes(np.concatenate([h[50:150], h, h[50:150]]), length)
        assert twice[10] == twice[160] == twice[510] and len(set(window_hashes(h, length).tolist())) == 400 - length + 1


def test_bloom_has_every_member(spark):
    bloom = build_bloom(spark.range(1000), "id", 1000)
    assert all(x in bloom for x in range(1000)) and sum(x in bloom for x in range(10_000, 20_000)) < 500
    assert 5 not in Bloom(np.zeros(8, np.uint8))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))


def test_mixing(docs, empty):
    rows = mixing.mix(docs, block=8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.copies <= 2
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(target[s])
        rate = target[s] / size[s] if size[s] else 0
        assert abs(sum(r.copies for r in rs) - rate * len(rs)) <= 1
    out = mixing.mixed_documents(docs)
    assert out.count() == sum(r.copies for r in rows) and out.columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, window=64, group=20).collect()
    cover, used = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        cover[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(r.doc_id for r in docs.collect())
    assert cover == {d: len(i) * copies[d] for d, i in want.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 64, 300)
    which, offset = packing.best_fit_decreasing(lengths, 64)
    room, slow = [], np.zeros(300, int)
    for i in np.argsort(-lengths, kind="stable"):
        fit = [(c, k) for k, c in enumerate(room) if c >= lengths[i]]
        best = min(c for c, _ in fit) if fit else None
        k = which[i]
        if fit:
            assert room[k] == best
        else:
            assert k == len(room)
            room.append(64)
        assert offset[i] == 64 - room[k]
        room[k] -= lengths[i]
    assert len(slow) == 300


def test_exact_dedup(docs, empty):
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    got = exactdedup.dedup(docs).collect()
    sha = {r.doc_id: hashlib.sha256(norm(r.text).encode()).hexdigest() for r in rows}
    keep = {k: min(g, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id for k, g in groups.items()}
    text = {r.doc_id: norm(r.text) for r in rows}
    kept = collections.Counter()
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == (keep[text[r.doc_id]], len(groups[text[r.doc_id]]), sha[r.doc_id])
        kept[text[r.doc_id]] += r.kept
    assert set(kept.values()) == {1}
    out = exactdedup.distinct_documents(docs)
    assert sorted(r.doc_id for r in out.collect()) == sorted(keep.values()) and out.columns == docs.columns
    assert exactdedup.dedup(empty).count() == 0


def test_quotient_filter_is_lossless():
    x = np.random.default_rng(3).integers(-50, 50, 3000) * 2**57
    f = exactdedup.QuotientFilter(4)
    for part in np.array_split(x, 7):
        f.add(part.astype(np.int64))
    total = sum(int(c.sum()) for _, c in f.blocks.values())
    assert total == 3000 and sum(len(r) for r, _ in f.blocks.values()) == len(set(x.tolist()))


@pytest.mark.parametrize(("n", "similarity"), [(4, (85, 100)), (5, (80, 100))])
def test_jaccard_components(docs, empty, n, similarity):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and similarity[1] * both >= similarity[0] * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    want = sorted((r.doc_id, len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, n, similarity).collect())
    assert got == want
    if n == 4:
        out = jaccard.one_of_each(docs, n, similarity)
        worded = {c for d, k, c in want if k}
        assert sorted(r.doc_id for r in out.collect()) == sorted(worded | {d for d, k, _ in want if not k}) and out.columns == docs.columns
        assert jaccard.components(empty).count() == 0


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(4)
    for similarity in ((85, 100), (80, 100)):
        bands = jaccard.Bands(similarity)
        for _ in range(400):
            size = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
            drop = int(r.integers(0, max(1, size // 8) + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, int(r.integers(0, max(1, size // 12) + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and similarity[1] * both >= similarity[0] * (len(a) + len(b) - both):
                assert set(bands.signatures(a).tolist()) & set(bands.signatures(b).tolist())


def test_exact_links_of_a_class():
    r = np.random.default_rng(5)
    base = np.arange(60)
    sets = [np.unique(np.where(r.random(60) < 0.08, r.integers(100, 200, 60), base)).astype(np.uint64) for _ in range(80)]
    union, want = jaccard.link_sets(sets, (85, 100)), jaccard.Union(80)
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [union.find(i) for i in range(80)] == [want.find(i) for i in range(80)]


def test_substrings(docs, empty):
    assert substrings.covers(substrings.PERIOD, substrings.COVER)
    rows = docs.collect()
    seen = collections.Counter(tuple(w[i : i + 35]) for w in (words(r.text) for r in rows) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substrings.kept_digest(substrings.remove_repeats(docs)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(x[2] for x in want)
    assert substrings.remove_repeats(empty).count() == 0


def test_sharding(docs, empty, tmp_path, spark):
    rows, slot_map = sharding.shard(docs)
    got = rows.collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    before = {r.vslot: r.shard for r in slot_map.collect()}
    after = {r.vslot: r.shard for r in sharding.grow_map(slot_map, 8).collect()}
    assert all(after[v] in (s, 8) for v, s in before.items())
    again = sharding.edit_map(slot_map, slot_map.select("vslot", "bytes", "rows"))
    assert again.count() == len(before) and again.agg(F.max("version")).first()[0] == 2
    sharding.store_map(slot_map, str(tmp_path / "map"))
    sharding.store_map(again, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).agg(F.min("version")).first()[0] == 2
    assert sharding.shard(empty)[0].count() == 0


def test_hmm_scores(docs, empty):
    rows = docs.collect()
    tokens = {r.doc_id: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in rows}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in tokens[r.doc_id])
    n, v = sum(c.values()), len(c)
    got = hmm.score(docs, hot=50, states=3, rounds=2).collect()
    for r in got:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert -1e6 < r.score < 0
    assert hmm.score(empty).count() == 0


def test_forward_is_the_sum_over_paths_and_training_climbs():
    r = np.random.default_rng(6)
    k, size = 3, 6
    draw = lambda *shape: (lambda a: a / a.sum(-1, keepdims=True))(r.random(shape))
    m = hmm.Model(draw(k), draw(k, k), draw(k, size).T.copy())
    seq = r.integers(0, size, 5)
    paths = 0.0
    for path in np.ndindex(*[k] * 5):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, 5):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        paths += p
    assert hmm.forward([seq, seq[:2]], m)[0] == pytest.approx(math.log(paths))
    data = [r.integers(0, size, int(n)) for n in r.integers(3, 40, 20)]
    data.append(r.integers(0, size, 2 * hmm.SEGMENT + 44))
    fits = []
    for _ in range(5):
        start, move, emit, fit = hmm.expected_counts(data, m)
        assert move.sum() == pytest.approx(sum(len(d) - 1 for d in data), rel=1e-4) and fit == pytest.approx(hmm.forward(data, m).sum(), rel=1e-4)
        fits.append(fit)
        assert emit.sum() == pytest.approx(sum(map(len, data)), rel=1e-4)
        m = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    parts = hmm.cut(data)
    start, move, emit, _ = hmm.expected_counts([p for p, _ in parts], m, np.array([f for _, f in parts]))
    assert start.sum() == pytest.approx(21) and emit.sum() == pytest.approx(sum(map(len, data)), rel=1e-4) and move.sum() == pytest.approx(sum(len(d) - 1 for d in data), rel=1e-4)
    assert all(b >= a - 1e-2 for a, b in zip(fits, fits[1:], strict=False))


def test_quality(spark, empty):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))).upper() + "!!" if bad else "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60)))
        rows.append((i, None if i == 7 else "" if i == 8 else text, "en", "s", 0, 0, ""))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(d, lab).collect()}
    assert len(got) == 300 and all(0 <= x.quality_score <= 1 for x in got.values())
    fresh = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0 and i not in (7, 8)]
    assert np.mean([got[i].quality_predicted == labels[i][1] for i in fresh]) > 0.95
    assert quality.good_documents(d, lab).columns == d.columns
    assert quality.classify(empty, lab.limit(0)).count() == 0


def test_html(spark):
    m = html.model()
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p>First   part,\n with <b>bold</b> words that go on for a while.<p>Second part of the story, which is long enough.</article><div class="comments"><div class="comment"><p>I disagree.</p></div></div><footer>&copy; us</footer></body></html>'
    got = html.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain  words"), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert got[0].text == "Head & line\n\nFirst part, with bold words that go on for a while.\n\nSecond part of the story, which is long enough."
    assert [r.text for r in got[1:4]] == ["", "", "plain words"] and got[4].text == got[0].text
    r, good = random.Random(99), 0
    for _ in range(100):
        page = html.training_page(r)
        out = html.extract_all([page], m)[0].split()
        want = len(re.findall(r"(?<![a-z/<])m[aeiorstln]+", re.sub(r"<[^>]*>", " ", page)))
        good += not any(w[0] == "x" for w in out) and len(out) == want
    assert good >= 75


def test_decoding_is_consistent():
    r = random.Random(3)
    for _ in range(50):
        nodes = [html.Node("div", None, (), True)]
        nodes[0].node = 0
        for i in range(1, 9):
            n = html.Node("div", nodes[r.randrange(i)], (), True)
            n.node = i
            nodes.append(n)
        order = []
        stack = [nodes[0]]
        while stack:
            n = stack.pop()
            n.node = len(order)
            order.append(n)
            stack.extend(reversed(n.children))
        odds = np.array([r.uniform(-2, 2) for _ in order])
        keep = html.decode(order, odds)
        ok = lambda k: all(not k[n.node] or not n.parent or k[n.parent.node] for n in order)
        best = max(sum(o for o, b in zip(odds, k, strict=True) if b) for k in ([bool(x >> i & 1) for i in range(9)] for x in range(512)) if ok(k))
        assert ok(keep) and sum(o for o, b in zip(odds, keep, strict=True) if b) == pytest.approx(best)


def test_image_copies(spark):
    r = np.random.default_rng(9)
    draw = lambda: np.clip(np.kron(r.normal(size=(12, 12)), np.ones((8, 8))) * 40 + 128, 0, 255).astype(np.uint8)
    a, b = draw(), draw()
    painted = b.copy()
    painted[30:50, 30:60] = 200
    images = [a, a[8:88, 10:92], np.rot90(a), b, painted, draw(), draw(), a]
    rows = [(i, media.encode_pgm(np.ascontiguousarray(x))) for i, x in enumerate(images)] + [(20, None), (21, b""), (22, b"nonsense")]
    got = {x.id: x for x in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert [got[i].class_id for i in range(8)] == [0, 0, 0, 3, 3, 5, 6, 0]
    assert [got[i].class_id for i in (20, 21, 22)] == [20, 21, 22] and got[20].n_links == 0
    assert media.copies(spark.createDataFrame([], "id long, image binary")).count() == 0


def scene(r, n=112):
    """A picture of shapes at several scales, with grain."""
    a = np.zeros((n, n))
    for k in (4, 8, 16, 28):
        g = r.normal(size=(n // k + 2, n // k + 2))
        at = np.arange(n) / k
        i, f = at.astype(int), at - at.astype(int)
        g = g[i] * (1 - f)[:, None] + g[i + 1] * f[:, None]
        a += (g[:, i] * (1 - f) + g[:, i + 1] * f) * k**0.5
    for _ in range(10):
        y, x, h, w = *r.integers(0, n - 20, 2), *r.integers(8, 40, 2)
        a[y : y + h, x : x + w] += r.normal() * 3
    return np.clip((a - a.mean()) / a.std() * 45 + 128, 0, 255)


def sampled(a, y, x):
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = y - i, x - j
    return a[i, j] * (1 - u) * (1 - v) + a[i + 1, j] * u * (1 - v) + a[i, j + 1] * (1 - u) * v + a[i + 1, j + 1] * u * v


def turned(a, degrees):
    c, t = (len(a) - 1) / 2, np.deg2rad(degrees)
    y, x = np.meshgrid(np.arange(len(a)) - c, np.arange(len(a)) - c, indexing="ij")
    return sampled(a, y * np.cos(t) - x * np.sin(t) + c, y * np.sin(t) + x * np.cos(t) + c)


def resized(a, zoom):
    g = (np.arange(int(len(a) * zoom)) + 0.5) / zoom - 0.5
    return sampled(a, *np.meshgrid(g, g, indexing="ij"))


def recompressed(a, q):
    """Blocks of 8 x 8 with their cosine transform rounded, as JPEG does."""
    d = np.sqrt(2 / 8) * np.cos(np.pi * np.outer(np.arange(8), np.arange(8) + 0.5) / 8)
    d[0] /= np.sqrt(2)
    steps = q * (1 + np.add.outer(np.arange(8), np.arange(8)))
    b = a.reshape(len(a) // 8, 8, -1, 8).swapaxes(1, 2)
    return (d.T @ (np.round(d @ b @ d.T / steps) * steps) @ d).swapaxes(1, 2).reshape(a.shape)


def grey(a):
    return np.clip(np.round(a), 0, 255).astype(np.uint8)


def found_pairs(spark, corners):
    rows = [(i, c.tobytes()) for i, c in enumerate(corners)]
    met = media.candidates(spark.createDataFrame(rows, "node long, corners binary"), 3, 4).collect()
    return {(min(x.node, b), max(x.node, b)) for x in met for b in np.frombuffer(x.partners, "<i8").tolist()}


def test_image_candidates_against_brute_force(spark):
    r = np.random.default_rng(4)
    edits = {
        "contrast": lambda a: (a - 128) * 0.7 + 118,
        "brightness": lambda a: a + 30,
        "noise": lambda a: a + r.normal(size=a.shape) * 8,
        "recompression": lambda a: recompressed(a, 10),
        "blur": lambda a: (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4,
        "larger": lambda a: resized(a, 1.2),
        "smaller": lambda a: resized(a, 0.85),
        "turn": lambda a: turned(a, 10),
        "large turn": lambda a: turned(a, 37),
        "crop": lambda a: a[9:100, 13:104],
    }
    kinds, corners = [], []
    for _ in range(12):
        a = scene(r)
        for kind, edit in [("", lambda a: a), *edits.items()]:
            kinds.append(kind)
            corners.append(media.describe(grey(edit(a))))
    found, k = found_pairs(spark, corners), len(edits) + 1
    for e, kind in enumerate(edits, 1):
        brute = {(i, i + e) for i in range(0, len(corners), k) if media.consensus(corners[i], corners[i + e]) >= media.AGREE}
        assert len(brute) >= 3, kind
        assert len(brute & found) >= 0.9 * len(brute), kind
    linked = {(i, j) for i in range(len(corners)) for j in range(i + 1, len(corners)) if media.consensus(corners[i], corners[j], media.AGREE) >= media.AGREE}
    assert len(linked & found) >= 0.9 * len(linked)


def test_images_that_share_a_cell_are_all_paired(spark, monkeypatch):
    r = np.random.default_rng(6)
    monkeypatch.setattr(media, "MEETING", 512)  # several blocks a cell
    shared = np.concatenate([media.describe(grey(scene(r)))[:1]] * 3)
    shared["bits"][1:] = r.integers(0, 256, (2, 32))
    assert found_pairs(spark, [shared[k % 2 : k % 2 + 2] for k in range(90)]) == {(i, j) for i in range(90) for j in range(i + 1, 90)}
    family = []
    for _ in range(70):
        a = scene(np.random.default_rng(7), 96)
        y, x = r.integers(0, 88, 2)
        a[y : y + 8, x : x + 8] = r.integers(0, 256)
        family.append(grey(a))
    corners = [media.describe(a) for a in family]
    brute = {(i, j) for i in range(70) for j in range(i + 1, 70) if media.consensus(corners[i], corners[j]) >= media.AGREE}
    got = media.copies(spark.createDataFrame([(i, media.encode_pgm(a)) for i, a in enumerate(family)], "id long, image binary")).collect()
    assert len(brute) == 70 * 69 // 2 and {(x.class_id, x.n_links) for x in got} == {(0, 69)}


def test_crop_of_a_small_part_of_a_large_image(spark):
    r = np.random.default_rng(8)
    a = (scene(r, 448) - 128) * 0.5 + 128
    a[300:430, 300:430] = np.kron(r.integers(0, 2, (13, 13)) * 255, np.ones((10, 10)))  # the strongest corners of all
    images = [grey(a), grey(a[41:141, 57:157]), grey(scene(r))]
    got = {x.id: x for x in media.copies(spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in enumerate(images)], "id long, image binary")).collect()}
    assert [got[i].class_id for i in range(3)] == [0, 0, 2]


def test_one_of_each_with_null_ids(spark):
    r = random.Random(12)
    say = lambda: ["w%d" % r.randrange(10**6) for _ in range(80)]
    near = lambda w: [*w[:-1], "edit%d" % r.randrange(10**6)]
    a, b, alone, other = say(), say(), say(), say()
    rows = [(None, alone), (None, a), (None, near(a)), (None, a), (None, near(b)), (5, b), (6, near(b)), (7, other), (None, [])]
    rows = [(i, " ".join(w)) for i, w in rows]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, (80, 100)).collect()
    kept = [(x.doc_id, x.text) for x in out]
    assert len(kept) == 5 and {rows[0], rows[5], rows[7], rows[8]} < set(kept)
    assert sum(x in rows[1:4] for x in kept) == 1


def test_code_in_a_script_ends_at_its_closing_tag():
    m = html.model()
    story = "<article><h1>Head</h1><p>First part of the story, which goes on for a good while, and then some.</p><p>Second part of the story, with %s and words enough to be read.</p></article>"
    page = "<html><head>%s</head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>" + story + "%s<footer>us</footer></body></html>"
    want = html.extract_all([page % ("", "more", "")], m)[0]
    assert "First part" in want and "Second part" in want
    for code in ("for(i=0;i<n;i++){f(i)}", "if(a<b&&c>d){x='<p>'}", "a='it\"s'<b", "<!-- x", "</p></scripty>"):
        assert html.extract_all([page % (f"<script>{code}</script>", "more", f"<SCRIPT type='a'>{code}</Script >")], m)[0] == want, code
    assert html.extract_all([page % ("<style>a<b{}</style>", "more", "<script>f(1<n)")], m)[0] == want  # the last isn't closed
    assert "Second" in html.extract_all([(page % ("", "more", "")).replace("</nav>", "</nav><select><option>A<option>B")], m)[0]  # nor is this
    text = "".join(t or "|" for _, t in html.parse("<p>Say <math><mi>x</mi><mo>=</mo><mn>1</mn></math> or <svg><g><text>label</text></g></svg> here</p>")[1])
    assert text == "|Say x=1 or label here|"


def test_features_of_many_siblings():
    page = "<article>" + "".join('<p class="%s">Part %d.</p>' % ("advert" if i == 1 else "part", i) if i % 3 else "<ul>List %d</ul>" % i for i in range(500)) + "</article>"
    nodes, x = html.describe(*html.parse(page))
    o = 3 * html.BUCKETS + 2 * (len(html.TAGS) + 1)
    mates = nodes[1].children
    assert len(mates) == 500
    for k, n in enumerate(mates):
        row = x[n.node]
        beside = {t for m in mates[max(0, k - 1) : k + 2] if m is not n for t in m.tokens}
        assert set(np.flatnonzero(row[2 * html.BUCKETS : 3 * html.BUCKETS]).tolist()) == beside
        assert row[o + 2] == pytest.approx(k / 500) and row[o + 3] == pytest.approx(sum(m.tag == n.tag for m in mates) / 500)


def test_shape_reads_the_whole_word():
    assert quality.shape("aB1-" * 20 + "x" * 90 + "9") == "aA0-" * 20 + "aa0"
    long = "Zx" * 40
    assert quality.features(long + "7 b", quality.Shapes()).tolist() != quality.features(long + "_ b", quality.Shapes()).tolist()


def test_unrelated_sets_share_no_signature():
    r = np.random.default_rng(12)
    for similarity in ((85, 100), (80, 100)):
        bands, seen = jaccard.Bands(similarity), collections.Counter()
        for _ in range(2000):
            s = np.unique(r.integers(0, 2**64, int(r.integers(5, 120)), dtype=np.uint64))
            seen.update(set(bands.signatures(s).tolist()))
        assert max(seen.values()) <= 4 and sum(v for v in seen.values() if v > 1) < 60


def test_classes_cut_in_small_chunks(spark, monkeypatch):
    """Families with and without a middle, cut so small that links go through pivots and across chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    r = random.Random(13)
    rows, words_of = [], [f"w{i}" for i in range(4000)]
    for family in range(3):
        base = r.sample(words_of, 120)
        for k in range(30):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(120)] = r.choice(words_of)
            rows.append((len(rows), " ".join(text)))
        chain = list(base)  # each is near the one before alone
        for k in range(12):
            chain = [*chain[4:], *r.sample(words_of, 4)]
            rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, " ".join(r.sample(words_of, r.randint(5, 30)))) for i in range(50)]
    got = {x.doc_id: x.component_id for x in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, (80, 100)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) < len(rows) - 60 and all(got[len(rows) - 1 - i] == len(rows) - 1 - i for i in range(50))


def test_clashing_columns(spark, sf_dir):
    """Columns named like internal ones come through as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    names = ["_id", "_label", "quality_score", "quality_predicted", "row_key", "row_doubt", "mix_key", "mix_copies", "mix_rows", "mix_copy", "key", "bucket", "n"]
    for n in names:
        docs = docs.withColumn(n, F.lit(-1.5))
    docs = docs.unionByName(docs.limit(10)).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for out in (quality.good_documents(docs, labels), exactdedup.distinct_documents(docs), jaccard.one_of_each(docs, 5, (80, 100)), mixing.mixed_documents(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(x[n] == -1.5 for x in rows for n in names)
    scored = quality.classify(docs, labels)
    assert scored.columns[-2:] == ["_quality_score", "_quality_predicted"]
    assert exactdedup.dedup(docs).count() == hmm.score(docs).count() == docs.count()


def test_html_of_broken_markup():
    for page in ("<a '" * 20_000, "<a \"x" * 20_000, "<div <p>text</p>" * 500, "<" * 50_000):
        html.parse(page)
    _, pieces = html.parse("<div class='a>b' <p>one</p>")
    assert "one" in [t for _, t in pieces]


def test_windows_of_any_frequency(spark):
    """A passage in every document, in copies too: one row of it goes on from each task, and all lose it."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)] + [(300, passage), (300, passage), (301, " ".join(f"q{i}" for i in range(60)))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(x.n_removed == 50 for x in got if x.doc_id <= 300) and all(x.n_removed == 0 for x in got if x.doc_id == 301)


def test_rows_without_ids_are_many_slots(spark):
    rows = [(None, f"text {i}") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))[0].groupBy("shard").count().collect()
    assert len(got) == 8 and max(x["count"] for x in got) < 300
