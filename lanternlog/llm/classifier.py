"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its character classes, word lengths and repetitions by a
small layer; gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages; the document's score is
a logistic unit on the weighted sum. Weights of all three parts are learned from document labels alone.

Training uses a bounded sample of labelled rows (``SAMPLE``, the rows with the smallest hash of their id), encoded by
Spark and fitted with array operations. The fitted model is a few hundred numbers; scoring is one pass over the texts
without a shuffle.

Defined results: a null text is empty; an empty text is one passage without words. A null id is scored, is never held
out and never trains. Several labels of an id count as the largest; null labels count as none. Without labels every
score is 0.5; with labels of one kind, that kind. Repeated rows are scored each. An empty table gives an empty table.
Columns other than ``doc_id`` and ``text`` are not read, and of the labels only ``doc_id`` and ``quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import arrow_map
from .shingles import mixed, word_hashes

SAMPLE = 3000
PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 12, 8
EPOCHS, BATCH, RATE = 40, 64, 0.01
SEED = "quality"
#: Words of a text encoded at a time.
CHUNK_WORDS = 64 * 2048

#: Character classes that are counted: capitals, small letters, digits, stops, symbols, bars, shouts, line ends, others.
CLASSES = (
    bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?", b"#*$%&<>", b"|", b"!", b"\n", bytes(range(192, 256)),
)
ONE_HOT = np.stack([np.isin(np.arange(256), list(c)) for c in CLASSES], 1).astype(np.int32)
FEATURES = len(CLASSES) + 6


def encode(text: str | None) -> np.ndarray:
    """One row of features per passage of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    hashes = word_hashes(b" ".join(words))
    thrice = mixed(hashes[2:] + np.uint64(3) * mixed(hashes[1:-1] + np.uint64(5) * hashes[:-2])) if len(words) > 2 else hashes[:0]
    again = np.ones(len(words), bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    repeats = np.zeros(len(words), bool)
    repeats[2:] = True
    repeats[2 + np.unique(thrice, return_index=True)[1]] = False
    rows = []
    for low in range(0, len(words), CHUNK_WORDS):
        high = min(len(words), low + CHUNK_WORDS)
        firsts = np.arange(low, high, PASSAGE_WORDS)
        n = np.minimum(high - firsts, PASSAGE_WORDS)
        begin, stop = int(starts[low]), int(starts[high]) if high < len(words) else len(raw)
        counts = np.add.reduceat(ONE_HOT[raw[begin:stop]], starts[firsts] - begin, axis=0)
        chars = np.diff(np.append(starts[firsts], stop))
        number = np.repeat(np.arange(len(n)), n)
        different = np.bincount(np.unique(np.stack([number.astype(np.uint64), hashes[low:high]], 1), axis=0)[:, 0].astype(np.int64), minlength=len(n))
        extra = (chars / n / 8, np.log1p(n), different / n, np.bincount(number, again[low:high]) / n, np.bincount(number, repeats[low:high]) / n, np.ones(len(n)))
        rows.append(np.column_stack([counts / n[:, None], *extra]))
    return np.concatenate(rows).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """The model; bags are given as stacked passages and the place where each bag begins."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": r.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
            "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -10, 10)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        n = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return x, h, t, g, a, n, z, sigmoid(z @ p["c"] + p["d"])

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, a, n, z, score = self.forward(x, starts)
        error = (score - y) / len(y)
        dz = np.repeat(error[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
        dt, dg = de[:, None] * p["w"] * g, de[:, None] * p["w"] * t
        dv, du = dt * (1 - t**2), dg * g * (1 - g)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ de, "c": z.T @ error, "d": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> GatedAttention:
        """Minimise the log loss with adaptive steps over shuffled batches."""
        r = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for low in range(0, len(order), BATCH):
                own = order[low : low + BATCH]
                chosen = [bags[i] for i in own]
                grads = self.gradients(np.concatenate(chosen), np.cumsum([0, *map(len, chosen[:-1])]), labels[own])
                step += 1
                for k, grad in grads.items():
                    grad = grad + 1e-4 * self.p[k] * (k not in "bd")
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


class Constant:
    """Stands in where there is nothing to learn from."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.score)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention | Constant:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    order = F.md5(F.concat(F.lit(SEED), F.col("id").cast("string")))
    known = known.orderBy(order, "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))

    def features(batch: dict) -> dict:
        return {"id": batch["id"], "quality": batch["quality"], "bag": [encode(x).tobytes() for x in batch["text"]]}

    bags = arrow_map(rows.select("id", "quality", "text"), features, "id bigint, quality int, bag binary")
    got = sorted((r["id"], r["quality"], bytes(r["bag"])) for r in bags.collect())
    got = list({r[0]: r for r in got}.values())
    y = np.array([float(q > 0) for _, q, _ in got])
    if len(set(y)) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in got]
    stacked = np.concatenate(x)
    return GatedAttention(stacked.mean(0), stacked.std(0) + 1e-3).fit(x, y)


def score(docs: DataFrame, model: GatedAttention | Constant) -> DataFrame:
    """The columns of ``docs`` as the struct ``row``, and the score."""
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = pc.struct_field(part["row"], "text").to_pylist()
                scores = model.scores([encode(x) for x in texts])
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(scores, pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
