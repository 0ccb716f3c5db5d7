"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import stored

#: Words in a passage.
PASSAGE = 96
#: Labelled documents that the classifier is fitted on at most.
SAMPLE = 4000
HIDDEN, EPOCHS, RATE = 16, 40, 0.01


def _byte_classes() -> np.ndarray:
    """16 classes of UTF-8 bytes: letters by case, digits, kinds of signs, leading and following bytes."""
    table = np.full(256, 15, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[list(b" \t\x0b\x0c\r")] = 3
    table[ord("\n")] = 4
    for number, signs in enumerate((b".,", b"!?", b";:'\"", b"-_", b"#*$%&", b"|<>\\/", b"()[]{}", b"@+=~^`"), 5):
        table[list(signs)] = number
    table[0x80:0xC0] = 13
    table[0xC0:] = 14
    return table


_CLASS = _byte_classes()
#: Class frequencies, frequencies of class pairs, and nine measures of the words.
WIDTH = 16 + 256 + 9


def passages(text: str | None) -> np.ndarray:
    """Features of every passage of a whole text, one row each; a text without words is one row of zeros."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    count = -(-len(words) // PASSAGE)
    which = np.arange(len(words)) // PASSAGE
    sizes = np.bincount(which, minlength=count).astype(float)
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    # A byte belongs to the passage of the last word that began before it.
    begins = np.flatnonzero(np.diff(((classes != 3) & (classes != 4)).astype(np.int8), prepend=0) == 1)
    cuts = np.append(begins[PASSAGE::PASSAGE][: count - 1], len(classes))
    passage = np.repeat(np.arange(count), np.diff(cuts, prepend=0))
    single = np.bincount(passage * 16 + classes, minlength=count * 16).reshape(count, 16)
    pairs = classes[:-1].astype(np.int64) * 16 + classes[1:]
    double = np.bincount(passage[1:] * 256 + pairs, minlength=count * 256).reshape(count, 256)
    length = np.maximum(single.sum(1, keepdims=True), 1)
    return np.hstack([single / length, double / length, _words(words, which, count, sizes)]).astype(np.float32)


def _words(words: list[bytes], which: np.ndarray, count: int, sizes: np.ndarray) -> np.ndarray:
    """Lengths of the words, and how often they and their neighbourhoods repeat."""
    keys = np.fromiter(map(hash, words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))

    def mean(values):
        return np.bincount(which[len(which) - len(values) :], values, count) / sizes

    def repeated(values):
        order = np.lexsort((values, which[len(which) - len(values) :]))
        places, ranked = which[len(which) - len(values) :][order], values[order]
        again = (ranked[1:] == ranked[:-1]) & (places[1:] == places[:-1])
        return np.bincount(places[1:][again], minlength=count) / sizes

    average = mean(lengths)
    return np.stack(
        [
            average / 10,
            np.sqrt(np.maximum(mean(lengths.astype(float) ** 2) - average**2, 0)) / 10,
            mean(lengths > 20),
            mean(lengths <= 2),
            mean(keys[1:] == keys[:-1]),
            mean(keys[2:] == keys[:-2]),
            repeated(keys),
            repeated(keys[1:] * 31 + keys[:-1]),
            np.log1p(sizes) / 5,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """Encoder, gated attention and output; a constant ``prior`` where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float | None = None

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One score per document of ``sizes`` consecutive passages."""
        if self.prior is not None:
            return np.full(len(sizes), self.prior)
        scaled = np.clip((rows - self.mean) / self.scale, -8, 8)
        return _sigmoid(_forward(self.weights, scaled, sizes)["out"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, sizes: np.ndarray) -> dict:
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    encoded = np.tanh(x @ w["encode"] + w["encode_bias"])
    tan, gate = np.tanh(encoded @ w["tan"]), _sigmoid(encoded @ w["gate"])
    logits = (tan * gate) @ w["attend"]
    peak = np.maximum.reduceat(logits, first)
    raised = np.exp(logits - np.repeat(peak, sizes))
    attention = raised / np.repeat(np.add.reduceat(raised, first), sizes)
    pooled = np.add.reduceat(attention[:, None] * encoded, first)
    return {
        "first": first, "encoded": encoded, "tan": tan, "gate": gate, "attention": attention, "pooled": pooled,
        "out": pooled @ w["out"] + w["out_bias"],
    }


def _gradients(w: dict, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict:
    f = _forward(w, x, sizes)
    out = (_sigmoid(f["out"]) - labels) / len(labels)
    pooled = np.repeat(out[:, None] * w["out"], sizes, axis=0)
    lifted = (pooled * f["encoded"]).sum(1)
    logits = f["attention"] * (lifted - np.repeat(np.add.reduceat(f["attention"] * lifted, f["first"]), sizes))
    both = logits[:, None] * w["attend"]
    tan, gate = both * f["gate"] * (1 - f["tan"] ** 2), both * f["tan"] * f["gate"] * (1 - f["gate"])
    encoded = f["attention"][:, None] * pooled + tan @ w["tan"].T + gate @ w["gate"].T
    inner = encoded * (1 - f["encoded"] ** 2)
    return {
        "encode": x.T @ inner, "encode_bias": inner.sum(0), "tan": f["encoded"].T @ tan, "gate": f["encoded"].T @ gate,
        "attend": (f["tan"] * f["gate"]).T @ logits, "out": f["pooled"].T @ out, "out_bias": out.sum(),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, *, seed: int = 7) -> Model:
    """Fit on documents given as their passages; Adam over shuffled batches, the same for the same input."""
    if len(set(labels.tolist())) < 2:
        prior = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
    random, rows = np.random.default_rng(seed), np.concatenate(bags).astype(np.float64)
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-3)
    start = {"encode": (WIDTH, HIDDEN), "encode_bias": HIDDEN, "tan": (HIDDEN, HIDDEN), "gate": (HIDDEN, HIDDEN), "attend": HIDDEN, "out": HIDDEN}
    w = {k: random.normal(0, 0.3 / np.sqrt(np.atleast_1d(s)[0]), s) for k, s in start.items()}
    w["out_bias"] = np.array(0.0)
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    scaled = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            x, sizes = np.concatenate([scaled[i] for i in batch]), np.array([len(scaled[i]) for i in batch])
            step += 1
            for k, g in _gradients(w, x, sizes, labels[batch]).items():
                g = g + 1e-4 * w[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents, those of least MD5 of their id.

    Held-out ids, NULL labels and labels of ids without a document are left out; of contradicting labels of one id
    the least holds, and of repeated documents each counts. Ids and labels are joined
    before any text is read; the sampled texts become features on the executors, and only those, a
    bounded number, reach the driver.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("_label"))
    chosen = (
        known.join(docs.select("doc_id").distinct(), "doc_id")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )
    chosen = stored(chosen, "labelled")

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            bags = [passages(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["key", "label", "bag"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        texts.select(F.md5(F.col("doc_id").cast("string")).alias("key"), "_label", "text")
        .mapInArrow(features, "key string, label double, bag binary")
        .collect()
    )
    rows.sort(key=lambda r: (r.key, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in rows]
    return train(bags, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of every whole text, between 0 and 1; NULL and empty texts are scored as no words."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        bags = [passages(t.as_py()) for t in texts]
        if not bags:
            return pa.array([], pa.float64())
        sizes = np.array([len(b) for b in bags])
        return pa.array(model.scores(np.concatenate(bags), sizes))

    return docs.withColumn(name, scored(F.col(text_col)))
