"""Personal data, quality rules and the classifier."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import pii, quality_model, rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.in_order(found)


def test_plain_identifiers_agree_with_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("@@..ab1-+ 0(5_%9\n4é") for _ in range(rng.randint(0, 30)))
        assert pii.identifiers(text) == brute(text), text


@pytest.mark.parametrize("digit", ["0", "7"])
def test_digit_runs_of_any_length(digit):
    run = digit * 5_000
    for text in (f"{run}1.2.3.4", f"1.2.3.{run}4", f"a@{run}.b", f"+{run}", run, f"{run}@b.c"):
        assert isinstance(pii.identifiers(text), list)
    assert ("ip", 0, 5_007) in pii.identifiers("0" * 5_000 + "1.2.3.4")


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john at example dot com now", "email", "john at example dot com"),
        ("ask x [at] mail.com", "email", "x [at] mail.com"),
        ("ask y(at)mail(dot)org!", "email", "y(at)mail(dot)org"),
        ("j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("\uff0b\uff11 (456) 555-2186", "phone", "\uff0b\uff11 (456) 555-2186"),
        ("host 192 dot 168 dot 0 dot 12 up", "ip", "192 dot 168 dot 0 dot 12"),
        ("soft a\u200bb@c.de", "email", "a\u200bb@c.de"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    plain = pii.identifiers(text)
    found = [(k, text[a:b]) for k, a, b in pii.disguised_identifiers(text, plain)]
    assert (kind, source) in found


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
        ("call Plus-44 20 7946 0958 now", "phone", "Plus-44 20 7946 0958"),
        ("x [at] mail.com", "email", "x [at] mail.com"),
        ("x at mail (.) com", "email", "x at mail (.) com"),
        ("x at mail dot com", "email", "x at mail dot com"),
        ("x@mail {dot} com", "email", "x@mail {dot} com"),
        ("+44 20 7946 zero nine five eight", "phone", "+44 20 7946 zero nine five eight"),
    ],
)
def test_each_disguise_alone_in_a_text(text, kind, source):
    """What is found does not depend on unrelated words."""
    for whole in (text, text + ", an anecdote"):
        found = [(k, whole[a:b]) for k, a, b in pii.disguised_identifiers(whole, pii.identifiers(whole))]
        assert (kind, source) in found, whole


@pytest.mark.parametrize("label", ["se", "dev", "dk", "app", "mil", "no", "museum", "COM"])
def test_a_plain_at_before_any_public_label(label):
    text = f"write jane at mail dot example dot {label} now"
    found = [(k, text[a:b]) for k, a, b in pii.disguised_identifiers(text, [])]
    assert found == [("email", f"jane at mail dot example dot {label}")]


def test_a_plain_at_before_labels_and_prose():
    for text, source in (
        ("jane at corp (dot) internal", "jane at corp (dot) internal"),
        ("jane at the dot com", "jane at the dot com"),
        ("look at the dot to the left", None),
        ("look at one dot product", None),
    ):
        found = [text[a:b] for k, a, b in pii.disguised_identifiers(text, []) if k == "email"]
        assert found == ([source] if source else []), text


@pytest.mark.parametrize("text", ["we met at noon. dot com", "one two three go", "look at the dot matrix", "a (at) b", "née à 12h"])
def test_clean_texts_stay_clean(text):
    assert pii.identifiers(text) == [] and pii.disguised_identifiers(text, []) == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "a." * 150_000 + "@", "@" * 300_000):
        assert pii.disguised_identifiers(text, pii.identifiers(text)) == []


def test_masking_keeps_columns_and_rows(spark):
    rows = [(1, "to a@b.co now", "x"), (1, "to a@b.co now", "x"), (2, None, "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = sorted((tuple(r) for r in pii.mask(docs).collect()), key=repr)
    assert out == sorted([(1, "to [EMAIL] now", "x")] * 2 + [(2, None, "y"), (None, "", None)], key=repr)
    assert [len(r.spans) for r in pii.find(docs).orderBy("doc_id").collect()] == [0, 1, 1, 0]
    assert pii.find(docs.limit(0)).count() == 0


def counted(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_agree_with_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l\nl\n\n \nl", "É# ü*|", "\u2003 a\x1cb"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n#", "\na\na"]) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    found = {r.doc_id: r for r in rules.judge(docs).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.judge(docs.limit(0)).count() == 0


def prose(rng, n=120):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_weak_supervision_separates_without_labels(spark):
    rng = random.Random(5)
    good = [prose(rng) for _ in range(80)]
    bad = [" ".join(w + "%%%" for w in prose(rng).split()) for _ in range(10)] + [prose(rng).upper() + "!!" for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    found = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert all(found[i] for i in range(80)) and not any(found[i] for i in range(80, 100))
    state = rules.accuracies(rules.judge(docs)).first().state
    assert 0.7 < state.prior < 0.9 and len(state.rules) == len(rules.RULES)


def test_passages_cover_whole_texts():
    rows = quality_model.passages("Word " * 1000)
    assert rows.shape == (-(-1000 // quality_model.PASSAGE), quality_model.WIDTH)
    assert np.allclose(rows[:, :16].sum(1), 1)
    for text in (None, "", " \n "):
        assert not quality_model.passages(text).any()


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    x, sizes, labels = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    shapes = {"encode": (5, 3), "encode_bias": 3, "tan": (3, 3), "gate": (3, 3), "attend": 3, "out": 3}
    w = {k: rng.normal(size=s) for k, s in shapes.items()} | {"out_bias": np.array(0.2)}

    def loss(w):
        p = quality_model._sigmoid(quality_model._forward(w, x, sizes)["out"])
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    exact = quality_model._gradients(w, x, sizes, labels)
    for k, v in w.items():
        for i in np.ndindex(v.shape):
            up, down = {**w, k: v.copy()}, {**w, k: v.copy()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - exact[k][i]) < 1e-6


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(20, 300)) if i % 3 else " ".join([prose(rng, 1)] * 60)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality_model.fit(docs, labels)
    out = quality_model.score(docs, model).withColumn("held", quality_model.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in out if r.held and r.doc_id < 300]
    assert len(held) > 30 and sum(held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 302
    constant = quality_model.fit(docs, labels.limit(0))
    assert {r.score for r in quality_model.score(docs, constant).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), model).count() == 0
