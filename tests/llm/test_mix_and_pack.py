"""The mix, packing, URL lists, top-k search, chat roles and the pipeline."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import chat, mixing, packing, topk, urls

PATH = public_tokenizers.path("word_bpe_49k.json")


def filled(sizes, weights, share=1.5, most=2.0):
    """Targets by capping and sharing out again until none is above."""
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = share * sum(sizes) - sum(most * sizes[i] for i in capped)
        level = left / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def test_targets_and_takes(spark):
    rng = random.Random(1)
    for case in range(4):
        names = [None, "", "B", "a", "b", "é", "z"][: case + 3]
        rows = [(i, rng.choice(names), rng.randint(0, 40)) for i in range(300)] + [(i, names[-1], 50) for i in range(300, 500)]
        rows += [(7, "a", 3), (7, "a", 3), (None, "B", 4)]
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, words int").withColumn("target", F.lit("x"))
        found = mixing.assign(docs.drop("target"), F.col("words")).collect()
        order = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
        sizes = [sum(w for _, s, w in rows if s == name) for name in order]
        goal = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])
        for name, size, target in zip(order, sizes, goal):
            own = [r for r in found if r.source == name]
            assert {r.source_size for r in own} == {size} and all(abs(r.target - target) < 1e-6 for r in own)
            assert sum(r.taken for r in own) == int(target + 1e-9)
        assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
        again = mixing.assign(docs.drop("target").repartition(5), F.col("words")).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 10) for i in range(600)], "doc_id bigint, source string, words int")
    order = mixing.training_order(mixing.assign(docs, F.col("words"))).collect()
    places = [r.position for r in order]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    half = {s: sum(r.words for r in order if r.source == s and r.position < 0.5) / sum(r.words for r in order if r.source == s) for s in "abc"}
    assert abs(half["a"] - 0.625) < 0.03 and abs(half["b"] - 0.5) < 0.03 and abs(half["c"] - 0.375) < 0.03
    assert mixing.assign(docs.limit(0), F.col("words")).count() == 0
    empty = mixing.assign(docs.withColumn("words", F.lit(0)), F.col("words"))
    assert {(r.taken, r.target) for r in empty.collect()} == {(0, 0.0)}


def test_columns_of_any_name_pass_through(spark):
    """Names of working columns in the input, in the operator and in the stages."""
    names = ["position", "Words", "epoch", "size", "target", "uses", "_key", "_slice", "_in_0", "use", "_source", "_text", "_spans", "_score", "n_chars"]
    rows = [(i, "ab"[i % 2], "one two three\nfour", *[f"{n}{i}" for n in names[:-1]], 18) for i in range(40)]
    schema = "doc_id bigint, source string, text string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", n_chars int"
    docs = spark.createDataFrame(rows, schema)
    order = mixing.training_order(mixing.assign(docs, F.lit(4)))
    assert order.columns[-3:] == ["epoch", "words", "position"] and "Words" not in order.columns
    assert all(r["_key"] == f"_key{r.doc_id}" and r["_in_0"] == f"_in_0{r.doc_id}" and r["use"] == f"use{r.doc_id}" for r in order.collect())
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    found = mixed.collect()
    assert {r.doc_id for r in found} <= set(range(40)) and len(found) >= 40
    for r in found:
        assert all(r[n] == f"{n}{r.doc_id}" for n in names[:-1])
        assert "one two three\nfour".startswith(r.text) and r.n_chars == len(r.text)
    masked = corpus_pipeline.personal_data(spark, docs, "")
    assert masked.columns == docs.columns and {r["_spans"] for r in masked.collect()} == {f"_spans{i}" for i in range(40)}


def test_least_slack_is_optimal_around_its_longest_piece():
    rng = random.Random(2)
    for _ in range(60):
        counts: dict[int, int] = {}
        for _ in range(rng.randint(1, 9)):
            length = rng.randint(1, 30)
            counts[length] = counts.get(length, 0) + 1
        chosen = packing.least_slack(dict(counts), 32)
        pieces = sorted(itertools.chain.from_iterable([k] * n for k, n in counts.items()))
        longest, rest = pieces[-1], pieces[:-1]
        sums = {sum(c) + longest for n in range(len(rest) + 1) for c in itertools.combinations(rest, n)}
        best = min(packing.padding(s, 32) for s in sums if s <= 32)
        assert packing.padding(sum(k * n for k, n in chosen.items()), 32) == best
        assert all(n <= counts[k] for k, n in chosen.items())


def test_pieces_round_trip_and_fill_windows(spark):
    rng = random.Random(3)
    words = ["Hello", "WORLD.", "naïve", "don't", "x1y2", "…", "日本", "<|endoftext|>", "a\x1cb", "ÉTÉ,", "!!", "e\u0301"]
    texts = [None, "", " \t\n"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4000))) for _ in range(25)]
    docs = spark.createDataFrame([(i % 20, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, start int")
    cut = packing.pieces(docs.withColumn("doc_id", F.col("start").cast("bigint")), PATH)
    placed = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")), parts=3).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        own = sorted((r for r in placed if r.doc_id == i), key=lambda r: r.start)
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids and {r.doc_tokens for r in own} == {len(ids) // 4}
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length for r in own)
    by_sequence: dict[int, list] = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in placed)
    # Few pieces are left to choose from at the end: no more than two windows' worth of padding.
    assert sum(packing.padding(sum(n for _, n in p), 2048) for p in by_sequence.values()) < 2 * 2048
    joined = packing.sequences(packing.place(cut)).agg(F.sum(F.octet_length("ids")), F.max("n_tokens")).first()
    assert joined[0] == 4 * total and joined[1] <= 2048
    assert packing.place(packing.pieces(docs.limit(0), PATH)).count() == 0


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/"))


def page(url, canonical=None, refresh=None):
    tags = f"<LINK href='{canonical}' rel=canonical>" if canonical else ""
    tags += f'<meta content="0; URL={refresh}" http-equiv="refresh">' if refresh else ""
    return url, f"<html><head>{tags}</head></html>"


def test_urls_rules_and_aliases(spark):
    cases = [
        (page("http://A.Example.org/es/1#x"), ("a.example.org", "/es/1", "example.org/es/", "block")),
        (page("http://example.org"), ("example.org", "", None, "allow")),
        (page("ftp://x.com/de/1?q"), ("x.com", "/de/1", "com/de/", "block")),
        (page("http://alias.net/1", canonical="http://x.com/de/1?q"), ("alias.net", "/1", None, "block")),
        (page("http://alias.net/2", refresh="/1"), ("alias.net", "/2", None, "block")),
        (page("http://alias.net/3", canonical="http://gone.com/de/7"), ("alias.net", "/3", None, "block")),
        (page("http://alias.net/4", canonical="http://both.com/de/1"), ("alias.net", "/4", None, "allow")),
        (page("http://both.com/de/1", refresh="http://ok.org/a"), ("both.com", "/de/1", "com/de/", "block")),
        (page("http://far.net/r"), ("far.net", "/r", None, "block")),
        ((None, None), ("", "", None, "allow")),
        (("no scheme", "<p>"), ("", "", None, "allow")),
        (("x://y?a#b", None), ("y", "", None, "allow")),
    ]
    pages = spark.createDataFrame([(i, *c[0], "old") for i, c in enumerate(cases)] + [(90, *cases[3][0], "old")], "page_id bigint, url string, html string, host string")
    redirects = spark.createDataFrame([("http://far.net/r", "https://ALIAS.net/1"), (None, "http://x.com/")], "a string, b string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES, redirects=[redirects]).collect()}
    assert found == {i: c[1] for i, c in enumerate(cases)} | {90: cases[3][1]}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_top_k_agrees_with_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 300)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(900)]
    rows += [(i, [0.5] * 6) for i in range(900, 1300)] + [(5000, None), (None, [1.0] * 6), (5001, [float("nan")] * 6), (5002, [None] * 6), (5050, [1e30] * 6)]
    vectors = spark.createDataFrame([(*r, 1) for r in [*rows, rows[50]]], "vec_id bigint, embedding array<double>, rank int")
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and i not in (5000, 5001, 5002)}
    for q in (i for i in usable if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        expected = [(k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scores, 1)]
        assert [m[2] for m in mine] == [e[2] for e in expected]
        if q != 5050:
            assert mine == expected
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.limit(1), vectors.limit(1)).count() == 0


def best_path(model, symbols, opens):
    best = None
    for path in itertools.product(range(3), repeat=len(symbols)):
        p = model.start[path[0]] + model.emission[path[0], symbols[0]]
        for k in range(1, len(path)):
            p += (model.change if opens[k] else model.stay)[path[k - 1], path[k]] + model.emission[path[k], symbols[k]]
        best = p if best is None else max(best, p)
    return best


def test_viterbi_agrees_with_all_paths_and_blocks_with_the_whole(spark):
    rng = np.random.default_rng(5)
    parts = [np.log(rng.dirichlet(np.ones(k), n)) for n, k in ((1, 3), (3, 3), (3, 3), (3, chat._SYMBOLS))]
    model = chat.Model(parts[0][0], *parts[1:])
    symbols, opens = rng.integers(0, chat._SYMBOLS, 7), rng.integers(0, 2, 7)
    path = chat.viterbi(model, symbols, opens)
    score = model.start[path[0]] + model.emission[path[0], symbols[0]]
    for k in range(1, 7):
        score += (model.change if opens[k] else model.stay)[path[k - 1], path[k]] + model.emission[path[k], symbols[k]]
    assert abs(score - best_path(model, symbols, opens)) < 1e-9
    rows = [(1, i, "\n".join("word " * int(n) for n in rng.integers(0, 60, 4))) for i in range(1500)]
    told = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").repartition(7)
    found = sorted((r.place, r.line_no, r.role) for r in chat.roles(told, model).collect())
    lines = chat.lines_of(told, id_col="conv_id", order_col="turn", text_col="text").orderBy("place", "line_no").collect()
    whole = chat.viterbi(model, [r.symbol for r in lines], [r.opens for r in lines])
    assert [r[2] for r in found] == [chat.ROLES[k] for k in whole]


def test_roles_of_transcripts(spark):
    known = [(c, t, ("system", "user", "assistant", "user", "assistant")[t], ("Be kind.", "Why is that?", "Because " * 30, "And then?", "Then " * 40)[t]) for c in range(30) for t in range(5)]
    told = spark.createDataFrame(known, "conv_id bigint, turn bigint, role string, text string")
    model = chat.fit(told)
    found = chat.turns(chat.roles(told.drop("role"), model)).collect()
    assert sum(r.role == known[r.place][2] for r in found) >= 0.95 * len(found) and len(found) == 150
    raw = [(1, 0, "User: hi there\nmore of it\nAssistant: hello\nHuman: bye?"), (None, 0, None), (2, 1, ""), (2, 1, "")]
    parts = chat.turns(chat.roles(spark.createDataFrame(raw, "conv_id bigint, turn bigint, text string"), model)).collect()
    own = sorted((r.part, r.role, r.text) for r in parts if r.conv == 1)
    assert own == [(0, "user", "hi there\nmore of it"), (1, "assistant", "hello"), (2, "user", "bye?")]
    assert len(parts) == 6
    assert chat.turns(chat.roles(told.drop("role").limit(0), model)).count() == 0


def test_pipeline_stages_hand_on_documents(spark, tmp_path):
    rng = random.Random(7)
    good = [" ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(["Spam"] * 80) + str(i) for i in range(20)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(good + bad)]
    rows += [(200, good[0], "en", "a", 1), (201, good[1] + " me@mail.com", "en", None, 1), (202, None, None, None, None), (0, good[0], "en", "a", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], str(tmp_path)), "stage"))
    for frame in frames[1:-1]:
        assert frame.dtypes == frames[0].dtypes
    scored, single, masked, mixed, packed = (f.collect() for f in frames[1:])
    assert {r.doc_id for r in scored} >= set(range(60)) and not {r.doc_id for r in scored} & set(range(60, 80))
    assert {r.doc_id for r in single} - {202} == set(range(60))
    assert not any("@" in (r.text or "") for r in masked)
    words = sum(len((r.text or "").split()) for r in masked)
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * words) <= 3
    assert sum(r.length for r in packed if r.start == 0) and {r.doc_id for r in packed} <= set(range(60)) | {202}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, str(tmp_path)), "stage")
    assert empty.count() == 0


def test_tokens_are_not_sorted_for_ranks(spark):
    rows = [(i % 40, "alpha beta gamma " * (i % 9) + "delta " * (i % 2 * 3000)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = packing.pieces(docs, PATH, remember=False)
    placed = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")))
    lines = placed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Window [row_number()" in line)
    below = next(line for line in lines[at + 1 :] if "Project [" in line)
    assert "length#" in below and "ids#" not in below
    found, kept = placed.collect(), packing.pieces(docs, PATH).collect()
    key = ["doc_id", "start", "length", "doc_tokens", "ids"]
    assert sorted([r[k] for k in key] for r in found) == sorted([r[k] for k in key] for r in kept)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in found)
    slim = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()
    place = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted([r[k] for k in place] for r in found) == sorted([r[k] for k in place] for r in slim)


def test_tokenizer_forgets_words():
    tokenizer = packing.WordTokenizer(PATH)
    first = tokenizer.ids("Alpha, beta gamma")
    tokenizer.forget()
    assert not tokenizer.words and tokenizer.cores == {"": b""}
    assert tokenizer.ids("Alpha, beta gamma") == first
