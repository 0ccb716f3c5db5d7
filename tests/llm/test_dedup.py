"""SimHash components, similar texts, repeated strings and connected components against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barloom.llm import repeats, similar, simhash, tables
from barloom.llm.graph import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, key string"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts)], SCHEMA)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def near_texts(seed=1):
    rng, words, out = random.Random(seed), vocabulary(400, 2), []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((30, 90, 300)))]
        for changes in (0, 0, 1, 2, 5, 12):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    return out


def test_components_take_the_least_node(spark):
    edges = [(5, 3), (3, 9), (9, 5), (20, 21), (21, 22), (22, 23), (7, 7), (5, 3), (None, 2)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    expected = {5: 3, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20}
    assert dict(tuple(r) for r in found.collect()) == expected
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_every_pair_within_the_radius_shares_a_mask():
    rng, masks = random.Random(3), simhash.covering_masks((1 << 64) - 1, 3)
    assert len(masks) == 15
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not change & m for m in masks)


def test_simhash_agrees_with_all_pairs(spark):
    texts = [*near_texts(), None, "", " \n", "One two", "ONE  two", "ÀÉ ÀÉ ÀÉ ÀÉ", "a" * 200_000]
    found = {r.id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in found.items()} == prints
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component for i, r in found.items()} == components(close, prints)


def test_simhash_of_crowded_buckets(spark):
    """Far more fingerprints in one bucket than are compared in place."""
    rng = random.Random(5)
    prints = {rng.getrandbits(9) | rng.getrandbits(3) << 40 | 7 << 50 for _ in range(900)} | {rng.getrandbits(63) for _ in range(200)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    close = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert components(edges, prints) == components(close, prints)


def test_simhash_of_one_crowded_second_level_bucket(spark):
    """Sparse fingerprints that differ only in the bits one mask of the second level leaves free."""
    full, rng = (1 << 64) - 1, random.Random(11)
    second = [m | n for m in simhash.covering_masks(full, 3) for n in simhash.covering_masks(full & ~m, 3)]
    places = max(([i for i in range(64) if not m >> i & 1] for m in second if m >> 63), key=len)
    prints = {sum(1 << p for k, p in enumerate(places) if v >> k & 1) for v in rng.sample(range(1 << len(places)), 150)}
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    close = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert len(set(components(close, prints).values())) > 10
    assert components(edges, prints) == components(close, prints)


def test_simhash_merges_components_once_a_level(spark, monkeypatch):
    """Two finer levels take two merges, whatever their stars and edges; a third only for edges of the last."""
    monkeypatch.setattr(simhash, "DIRECT", 2)
    runs = []
    monkeypatch.setattr(simhash, "connected_components", lambda edges: runs.append(1) or connected_components(edges))
    rng = random.Random(12)
    prints = {rng.getrandbits(12) | 5 << 50 for _ in range(300)}
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()]
    close = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert components(edges, prints) == components(close, prints)
    assert len(runs) <= 2


def test_simhash_of_nothing_and_of_repeated_ids(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    found = simhash.near_duplicates(documents(spark, ["a b c d"] * 3 + ["zz yy xx ww"], [4, 4, None, None])).collect()
    assert sorted((r.id or -1, r.component or -1) for r in found) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_texts_keep_one_each(spark):
    texts = near_texts(4)
    docs = documents(spark, [*texts, None, "", "", "solo"])
    found = similar.without_near_duplicates(docs)
    assert found.columns == docs.columns
    kept = {r.doc_id for r in found.collect()}
    for a in range(len(texts)):
        for b in range(a):
            alike = jaccard(texts[a], texts[b])
            if alike >= 0.86:
                assert not {a, b} <= kept
    for a in range(len(texts)):
        if max(jaccard(texts[a], texts[b]) for b in range(len(texts)) if b != a) < 0.7:
            assert a in kept
    n = len(texts)
    assert kept & {n, n + 1, n + 2, n + 3} == {n, n + 3}


def pairs_around(low, high, count, seed):
    """Pairs of texts whose Jaccard similarity lies between the bounds."""
    rng, words, out = random.Random(seed), vocabulary(4000, 12), []
    while len(out) < count:
        text = [rng.choice(words) for _ in range(rng.choice((40, 120, 300)))]
        other = list(text)
        for _ in range(max(1, round(len(text) * rng.uniform(0.01, 0.06)))):
            other[rng.randrange(len(text))] = rng.choice(words)
        text, other = " ".join(text), " ".join(other)
        if low <= jaccard(text, other) < high:
            out.append((text, other))
    return out


def test_similar_texts_are_cut_at_the_exact_similarity(spark):
    """Pairs at 0.80 to 0.86 lose one text each, pairs at 0.70 to 0.80 none."""
    alike, apart = pairs_around(0.8, 0.86, 100, 13), pairs_around(0.7, 0.8, 60, 14)
    docs = documents(spark, [t for pair in alike + apart for t in pair])
    kept = {r.doc_id for r in similar.without_near_duplicates(docs).collect()}
    found = sum(2 * i + 1 not in kept for i in range(len(alike)))
    assert found >= 0.98 * len(alike), found
    assert all({2 * i, 2 * i + 1} <= kept for i in range(len(alike), len(alike) + len(apart)))


def test_similar_texts_meet_in_slices_of_buckets(spark, monkeypatch):
    """Members of open buckets never fill the disk all at once; each pair is still found."""
    written, write = [], tables.Stored.__init__
    monkeypatch.setattr(similar, "SLICE_ROWS", 1, raising=False)
    monkeypatch.setattr(tables.Stored, "__init__", lambda self, df, name: written.append(name) or write(self, df, name))
    rng, words = random.Random(4), vocabulary(300, 5)
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join([*base[:k], "q" * (k + 1), *base[k + 1 :]]) for k in range(0, 200, 10)]
    texts += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(5)]
    # Least of some buckets of the copies, and alike to none: those buckets stay open after the stars.
    texts += [" ".join(rng.choice(words) if k % 16 == 0 else w for k, w in enumerate(base)) for _ in range(30)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    kept = {r.doc_id for r in similar.without_near_duplicates(documents(spark, texts)).collect()}
    assert kept == set(components(pairs, range(len(texts))).values())
    assert written.count("ends") > 1


def test_similar_texts_always_share_a_bucket():
    """Sets at the similarity have a first shingle in common whatever the order; sketches differ in no more bits than sets."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        common, own, other = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (rng.integers(1, 90), rng.integers(0, 15), rng.integers(0, 15)))
        x, y = np.unique(np.concatenate([common, own])), np.unique(np.concatenate([common, other]))
        frequent = np.unique(rng.choice(common, len(common) // 2))
        counts = rng.integers(1, 5, len(frequent)).astype(np.int32)
        shared = len(np.intersect1d(x, y))
        if shared / len(np.union1d(x, y)) >= 0.8:
            assert len(np.intersect1d(*(similar.prefix(s, frequent, counts, 0.8) for s in (x, y))))
        apart = sum((int(a) ^ int(b)).bit_count() for a, b in zip(*(similar.parity(s).view(np.uint64) for s in (x, y))))
        assert apart <= len(x) + len(y) - 2 * shared


def test_similar_texts_of_a_large_group_leave_few_pairs_and_tables(spark, monkeypatch):
    """A group whose texts are partly alike is contracted, not paired; the tables of all steps go with the stage."""
    written, write = [], tables.Stored.__init__
    monkeypatch.setattr(tables.Stored, "__init__", lambda self, df, name: write(self, df, name) or written.append((name, self)))
    counts = {}
    drop = tables.Stored.drop
    monkeypatch.setattr(tables.Stored, "drop", lambda self: counts.update({self.path: self.df.count()}) or drop(self))
    rng, words = random.Random(6), vocabulary(4000, 5)
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(copy))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    kept = {r.doc_id for r in similar.without_near_duplicates(documents(spark, texts)).collect()}
    assert kept == set(components(pairs, range(len(texts))).values())
    left = {name for name, table in written if Path(table.path.removeprefix("file:")).exists()}
    assert left == {"edges"}
    assert counts and sum(counts[t.path] for name, t in written if name.endswith("-pairs")) < len(texts) ** 2 / 4


def test_similar_texts_of_nothing_and_repeated_rows(spark):
    assert similar.without_near_duplicates(documents(spark, [])).count() == 0
    same = documents(spark, ["one two three four five six"] * 4, [3, 3, None, 8])
    assert [r.doc_id for r in similar.without_near_duplicates(same).collect()] == [3]


def brute_repeats(rows):
    """{row number: (n_bytes, spans, kept)} by looking at every string of every smaller id."""
    data = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for i, text in data:
        before = {d[p : p + 50] for j, d in data if j is not None and (i is None or j < i) for p in range(len(d) - 49)}
        gone = bytearray(len(text))
        for p in range(len(text) - 49):
            if text[p : p + 50] in before:
                gone[p : p + 50] = b"\1" * 50
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(gone) if end < 0 else end
            spans.append((at, end))
            at = end
        out.append((i, len(text), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def test_repeated_strings_agree_with_all_strings(spark):
    rng, words = random.Random(6), vocabulary(60, 7)

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, long = prose(12), prose(900)
    texts = [prose(40), passage, prose(5) + passage + prose(5), passage[:60] + prose(3), passage[3:52], passage[3:53], "ab" * 200, "ba" * 90]
    texts += [long, long, long[:2000] + "X" + long[2001:], prose(3) + "é" * 60, "é" * 45, None, "", "short", long[100:160] + passage]
    for t in list(texts[:6]):
        spot = rng.randrange(len(t))
        texts.append(t[:spot] + "#" + t[spot:])
    ids = [*rng.sample(range(100), len(texts) - 3), None, None, 50]
    docs = documents(spark, texts, ids)
    found = repeats.without_repeats(docs).collect()
    mine = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found), key=repr)
    assert mine == sorted(brute_repeats(list(zip(ids, texts))), key=repr)
    assert repeats.without_repeats(documents(spark, [])).count() == 0


def test_repeated_strings_are_compared_in_slices_of_names(spark, monkeypatch):
    """Strings of ambiguous names never fill the disk all at once; what is found stays the same."""
    written, write = [], tables.Stored.__init__
    monkeypatch.setattr(repeats, "SLICE_CLASSES", 4, raising=False)
    monkeypatch.setattr(tables.Stored, "__init__", lambda self, df, name: written.append(name) or write(self, df, name))
    rng, words = random.Random(9), vocabulary(60, 10)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [passage[a:b] + rng.choice(words) for a in range(0, 120, 30) for b in (200, 230, 260)] + [passage, passage + "."]
    found = repeats.without_repeats(documents(spark, texts)).collect()
    mine = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found), key=repr)
    assert mine == sorted(brute_repeats(list(enumerate(texts))), key=repr)
    assert any(spans for _, _, spans, _ in mine) and written.count("resolved") > 1


@pytest.mark.parametrize("cut", [0, 1, 25])
def test_sampled_positions_follow_the_bytes(cut):
    """A string samples the same place of itself wherever it stands; every string samples one."""
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    at, name, first, last = repeats.anchors(text)
    assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
    other, _, f2, l2 = repeats.anchors(text[cut:])
    place = {p: a for a, f, l in zip(at, first, last) for p in range(f, l + 1)}
    for a, f, l in zip(other, f2, l2):
        assert all(place[p + cut] == a + cut for p in range(f, l + 1))
    assert len(at) < len(text) / 8 and hashlib.sha256(name.tobytes())


def test_ranges_are_merged_without_an_object_each():
    def plain(text, whole, ranges):
        data = (text or "").encode()
        gone = set(range(len(data))) if whole and len(data) >= 50 else {x for a, b in ranges or () for x in range(a, b)}
        starts, ends = (sorted(x for x in gone if x + step not in gone) for step in (-1, 1))
        spans = [{"a": a, "b": b + 1} for a, b in zip(starts, ends, strict=True)]
        return {"n_bytes": len(data), "spans": spans, "kept": bytes(c for i, c in enumerate(data) if i not in gone)}

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    rng, rows = random.Random(5), [(None, None, None), ("", True, []), ("x" * 49, True, None), ("é" * 25, True, [(0, 50)])]
    for _ in range(200):
        text = "aé日" * rng.randint(9, 40)
        starts = [rng.randint(0, len(text.encode()) - 50) for _ in range(rng.randint(0, 5))]
        rows.append((text, rng.random() < 0.1, [(a, a + 50) for a in starts]))
    found = repeats._removed.func(*(pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.bool_(), kind))))
    assert found.to_pylist() == [plain(*row) for row in rows]
    text, count = "x" * 400_050, 400_000
    spans = pa.StructArray.from_arrays([pa.array(range(count)), pa.array(range(50, count + 50))], names=["a", "b"])
    ranges = pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), spans)
    tracemalloc.start()
    found = repeats._removed.func(pa.array([text]), pa.array([False]), ranges)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [{"n_bytes": 400_050, "spans": [{"a": 0, "b": 400_049}], "kept": b"x"}]
    assert peak < 60_000_000  # an object for each range takes more
