"""Collocations, licence scan and filter audit against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import audit, audit_sql, licenses, phrases, phrases_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string"


# --- collocations


def all_counts(rows):
    """f of every phrase of up to five words, and n, per lang."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def brute_collocations(rows, least):
    f, n = all_counts(rows)
    frequent = {k: v for k, v in f.items() if v >= least}
    inside = set()
    for (lang, words), c in frequent.items():
        for a, b in itertools.combinations(range(len(words) + 1), 2):
            if 2 <= b - a < len(words) and c >= f[lang, words[a:b]]:
                inside.add((lang, words[a:b]))
    out = []
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    rows = []
    for _ in range(size):
        words = [rng.choice(["Of", "of", "the", "The", "a", "é", "\x01b", "x\x1cy", "rare%d" % rng.randint(0, 50)]) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for w in words)
        rows.append((text, rng.choice(["en", "de", None, ""])))
    rows += [("The Same hot phrase again. " * 40, "en")] * 20 + [(None, "en"), ("", "de"), (" .,; ", None)]
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_collocations_agree_with_brute_force(spark, ranges):
    rows = corpus(ranges, 150)
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, f int").repartition(3)
    counts = phrases.phrase_counts(docs, least=7, ranges=ranges)
    f, n = all_counts(rows)
    found = {(r.lang, r.phrase): r.f for r in counts.collect()}
    assert {k: v for k, v in found.items() if k[1] is not None} == {(lang, " ".join(w)): c for (lang, w), c in f.items() if c >= 7}
    assert {k[0]: v for k, v in found.items() if k[1] is None} == {k: v for k, v in n.items() if v}
    mine = sorted(tuple(r) for r in phrases.collocations(counts).select("lang", "phrase", "a", "l", "r", "n", "score").collect())
    assert mine == brute_collocations(rows, 7) and mine


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 50)
    rows = [(t, lang or "und") for t, lang in corpus(9, 40) if t is not None] + [("one two three four five six " * 60, "en")]
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], names=["lang", "text"])
    bounds = {"en": [(b"of",), (b"of", b"the", b"zz"), (b"six", b"one"), (b"the", b"same", b"hot")]}
    groups = {}
    for out in phrases._router(bounds)(iter([batch])):
        for row in out.to_pylist():
            groups.setdefault((row["lang"], row["range"]), []).append(row["block"])
    found = Counter()
    for (lang, number), blocks in groups.items():
        table = pa.table({"block": pa.array(blocks, pa.binary())})
        for row in phrases._counter(bounds, 5)((pa.scalar(lang), pa.scalar(number)), table).to_pylist():
            found[lang, row["phrase"]] += row["f"]
    f, n = all_counts(rows)
    assert {k: v for k, v in found.items() if k[1] and v >= 5} == {(lang, " ".join(w)): c for (lang, w), c in f.items() if c >= 5}
    assert all(found[lang, None] == c for lang, c in n.items())


def test_quicksort_counts_every_frequent_run():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 4, 3000)
    columns = phrases.suffixes(ids, len(ids))
    counts = rng.integers(1, 4, len(ids))
    found = {tuple(int(c[row]) for c in columns[:depth]): total for row, depth, total in phrases.quicksorted(columns, counts, 30)}
    told = Counter()
    for k, count in enumerate(counts.tolist()):
        words = [int(c[k]) for c in columns]
        for depth in range(1, 6):
            if 0 not in words[:depth]:
                told[tuple(words[:depth])] += count
    assert found == {k: v for k, v in told.items() if v >= 30} and len(found) > 20


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right, n = 10**12 + 7, 10**12 + 39, 10**13 + 37, 10**16 + 61
    rows = [("x", None, n), ("x", "p q", a), ("x", "p", left), ("x", "q", right)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, f bigint")
    assert phrases.collocations(counts).first().score == 1000 * a * n // (left * right)


def test_collocations_of_nothing_are_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(phrases.phrase_counts(docs)).count() == 0


def test_collocation_sql_agrees_with_brute_force():
    rows = corpus(5, 60)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    theirs = db.execute(phrases_sql.OP11.replace(">= 100)", ">= 7)").replace("HAVING count(*) >= 100", "HAVING count(*) >= 7")).fetchall()
    assert sorted((r[0], *r[2:]) for r in theirs) == brute_collocations(rows, 7)


# --- licences


def test_matching_statistics_and_end_places():
    rng = random.Random(1)
    for _ in range(200):
        templates = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        automaton = licenses.Automaton(templates)
        words = [rng.randint(1, 4) for _ in range(20)]
        for i, (state, length) in enumerate(automaton.statistics(words)):

            def ends(k, i=i):
                held = words[i + 1 - k : i + 1]
                return [(n, p) for n, t in enumerate(templates) for p in range(k - 1, len(t)) if t[p + 1 - k : p + 1] == held]

            assert length == max(k for k in range(i + 2) if k == 0 or ends(k))
            if length:
                assert automaton.ends[state] == ends(length)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), sorted(
        (i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


MIT = licenses.TEMPLATES[0][1]
NOTICE = {}
for _label, _text in licenses.TEMPLATES:
    NOTICE.setdefault(_label, _text)


@pytest.mark.parametrize("label", sorted(NOTICE))
def test_a_notice_in_prose_has_its_label(label):
    found = licenses.found_in(licenses.Scanner(), "Some words of the author. " + NOTICE[label] + " And so it goes on, as is.")
    assert [s["label"] for s in found["spans"]] == [label]
    span = found["spans"][0]
    assert span["first"] == 5 and span["share"] == 1 and span["last"] - span["first"] + 1 == span["covered"]


def test_changed_and_partial_notices():
    scanner = licenses.Scanner()
    changed = licenses.found_in(scanner, MIT.replace("Software", "Library").replace("sell", "vend"))
    assert [s["label"] for s in changed["spans"]] == ["mit"] and 0.9 < changed["score"] < 1
    words = MIT.split()
    half = licenses.found_in(scanner, " ".join(words[: len(words) // 2]))
    assert half["spans"] == [] and 0.4 < half["score"] < licenses.LEAST_SHARE
    apart = " ".join(words[:80]) + " filler" * 500 + " " + " ".join(words[80:])
    assert licenses.found_in(scanner, apart)["score"] < licenses.LEAST_SHARE
    shuffled = words[:]
    random.Random(2).shuffle(shuffled)
    assert licenses.found_in(scanner, " ".join(shuffled))["spans"] == []


def test_scan_of_rows(spark):
    rng = random.Random(3)
    pool = ["GNU", "gnu", "general", "public", "License", "license", "apache", "cc", "BY", "by", "mit", "É", "9", "x_y"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "\x00\x7f ,", MIT + " of the " * 20_000 + "MIT License", "mit license " * 5_000, MIT * 30, "mit license " * 5_000]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id bigint, text string, label string")
    rows = licenses.scan(docs).collect()
    assert [r.label for r in rows] == ["a"] * len(texts)
    for row in rows:
        count, places = brute_base(texts[row.doc_id])
        assert row.found.n_words == count
        assert [(p.word, p.label) for p in row.found.places] == places
        assert 0 <= row.found.score <= 1
    assert rows[200].found.asDict(True) == {"n_words": 0, "places": [], "spans": [], "score": 0.0}
    assert {s.label for s in rows[203].found.spans} == {"mit"}
    assert rows[204].found == rows[206].found
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="found"):
        licenses.scan(docs.withColumnRenamed("label", "found"))


# --- filter audit


def brute_steps(weights, filters="ABCDE"):
    bit = {c: 1 << k for k, c in enumerate(filters)}
    rows = []
    for order in itertools.permutations(filters):
        left = dict(weights)
        for step, c in enumerate(order, 1):
            gone = {m: w for m, w in left.items() if m & bit[c]}
            left = {m: w for m, w in left.items() if not m & bit[c]}
            fails = sum(w[0] for m, w in weights.items() if m & bit[c])
            removed = [sum(w[k] for w in gone.values()) for k in range(3)]
            alone = weights.get(bit[c], (0,))[0]
            rows.append(["".join(order), step, sum(w[0] for w in left.values()), removed[0], fails - removed[0], alone, removed[1], removed[2]])
    summed = Counter()
    for r in rows:
        summed[r[0][r[1] - 1]] += r[3]
    return sorted((*r, summed[r[0][r[1] - 1]]) for r in rows)


def test_diagrams_agree_with_filters_applied_in_turn():
    rng = random.Random(8)
    for filters in ("A", "AB", "ABC", "ABCDE"):
        for _ in range(5):
            weights = {m: (rng.randint(0, 9), rng.randint(0, 3), rng.randint(0, 3)) for m in range(1 << len(filters)) if rng.random() < 0.6}
            found = audit.orders(weights, filters)
            assert sorted(tuple(r.values()) for r in found) == brute_steps(weights, filters)


def test_a_swap_changes_one_pair_of_levels_and_shares_nodes():
    diagram = audit.Diagram({0: (1,), 31: (1,)}, 5, 1)
    assert len(diagram.weight) < 16
    before = [w for _, *w in diagram.steps()]
    for _ in range(2):
        diagram.swap(3)
    assert diagram.order == list(range(5)) and [w for _, *w in diagram.steps()] == before
    walk = [tuple(range(4))]
    for k in audit.plain_changes(4):
        order = list(walk[-1])
        order[k], order[k + 1] = order[k + 1], order[k]
        walk.append(tuple(order))
    assert len(walk) == len(set(walk)) == 24


def test_audit_of_rows_agrees_with_sql(spark):
    rng = random.Random(6)
    texts = [None, "", "word " * 250, "CAPS " * 10, " ".join(f"w{k}" for k in range(300)), "a # b", "é" * 40 + "A", " x\x1cy\x0bz"]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [(400, texts[4], "fr")] * 3 + [(None, texts[4], "fr"), (None, "only without id", "fr"), (None, "only without id", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", mask int").repartition(4)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = audit.audit(audit.mask_counts(audit.failures(docs), told))
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    theirs = sorted(db.execute(audit_sql.OP13).fetchall())
    names = [c[0] for c in db.execute(audit_sql.OP13).description]
    assert sorted(tuple(r) for r in found.select(names).collect()) == theirs
    assert len(theirs) == 600 * 4
    assert audit.audit(audit.mask_counts(audit.failures(docs.limit(0)), told)).count() == 0


def test_copies_of_an_id_do_not_precede_each_other(spark):
    rows = [(1, "t", "a"), (1, "t", "a"), (2, "t", "b"), (None, "t", "b"), (None, "u", "b"), (None, "u", "b")]
    failed = audit.failures(spark.createDataFrame(rows, DOCS))
    copies = failed.groupBy("doc_id").agg(F.sum(F.when(F.col("mask") >= 16, F.col("n")).otherwise(0)).alias("copies")).collect()
    assert {r.doc_id: r.copies for r in copies} == {1: 0, 2: 1, None: 1}
