"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Each passage is encoded by its
character classes, its repetition and a projection of its hashed words, then
by a learned layer; gated attention (a tanh gate times a sigmoid gate) weighs
the passages, and the weighted sum is scored. All weights are learned from the
labels of documents, by Adam, on at most FIT_ROWS labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import crc_rest, map_arrow, texts_of

WORDS, HASHED, PROJECTED = 64, 8192, 32
#: Labelled documents that are fitted at most, about.
FIT_ROWS = 6_000
HIDDEN, GATE, EPOCHS, CACHE = 24, 12, 30, 200_000
_PROJECTION = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (HASHED, PROJECTED))
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 4
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 5
CLASSES = 6
FEATURES = CLASSES + 6 + PROJECTED
_seen: dict[bytes, int] = {}


def encode(text: bytes) -> np.ndarray:
    """Passages x FEATURES. A text without words is one passage of zeros with a flag."""
    words = text.split()
    n = len(words)
    if not n:
        out = np.zeros((1, FEATURES), np.float32)
        out[0, CLASSES + 5] = 1
        return out
    if len(_seen) > CACHE:
        _seen.clear()
    ids = np.empty(n, np.int32)
    for i, w in enumerate(words):
        h = _seen.get(w)
        if h is None:
            h = _seen[w] = xxhash.xxh32_intdigest(w.strip(b".,;:!?").lower()) & (HASHED - 1)
        ids[i] = h
    at = np.arange(0, n, WORDS)
    if n > WORDS and n - at[-1] < WORDS // 2:
        at = at[:-1]  # a short rest belongs to the passage before
    count = np.diff(np.append(at, n))
    size = np.fromiter(map(len, words), np.int64, n)
    b = np.frombuffer(b"".join(words), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])[at]
    chars = np.diff(np.append(begin, len(b)))
    cls = _CLASS[b]
    out = np.empty((len(at), FEATURES), np.float32)
    for c in range(CLASSES):
        out[:, c] = np.add.reduceat(cls == c, begin, dtype=np.int64) / chars
    mean = chars / count
    out[:, CLASSES] = mean / 10
    out[:, CLASSES + 1] = np.sqrt(np.maximum(np.add.reduceat(size * size, at) / count - mean * mean, 0)) / 10
    passage = np.repeat(np.arange(len(at)), count)
    key = np.sort(passage * HASHED + ids)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    out[:, CLASSES + 2] = np.bincount(key[new] // HASHED, minlength=len(at)) / count
    out[:, CLASSES + 3] = np.log1p(n) / 10
    lines = text.split(b"\n")
    out[:, CLASSES + 4] = 1 - len(set(lines)) / len(lines)
    out[:, CLASSES + 5] = 0
    out[:, CLASSES + 6 :] = np.add.reduceat(_PROJECTION[ids], at, axis=0) / count[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    center: np.ndarray
    spread: np.ndarray
    prior: float = 0.5

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Passages x of bags that start at ``at``."""
        w, n = self.weights, np.diff(np.append(at, len(x)))
        x = (x - self.center) / self.spread
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = (t * g) @ w["a"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
        a /= np.repeat(np.add.reduceat(a, at), n)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of documents, and the attention on their passages."""
        if not self.weights:
            return np.full(len(texts), self.prior), [np.ones(1)] * len(texts)
        bags = [encode(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        f = self.forward(np.concatenate(bags), at[:-1])
        return f["p"].astype(np.float64), np.split(f["a"], at[1:-1])


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Adam on cross entropy, in batches of bags. One label only gives its share as every score."""
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    if len(set(labels.tolist())) < 2:
        return Model({}, np.zeros(FEATURES), np.ones(FEATURES), prior)
    rng, x = np.random.default_rng(seed), np.concatenate(bags)
    m = Model({}, x.mean(0), x.std(0) + 1e-3, prior)
    shape = {"W": (FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": GATE, "c": HIDDEN, "d": ()}
    w = m.weights = {k: np.asarray(rng.normal(0, 0.2, s) if k not in "bd" else np.zeros(s), np.float32) for k, s in shape.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            n = np.array([len(bags[j]) for j in pick])
            at = np.cumsum(n) - n
            f = m.forward(np.concatenate([bags[j] for j in pick]), at)
            dp = ((f["p"] - labels[pick]) / len(pick)).astype(np.float32)
            dz = np.repeat(dp[:, None] * w["c"], n, axis=0)
            h, t, g, a = f["h"], f["t"], f["g"], f["a"][:, None]
            da = (dz * (h - np.repeat(f["z"], n, axis=0))).sum(1, keepdims=True) * a
            dt, dg = da * w["a"] * g * (1 - t * t), da * w["a"] * t * g * (1 - g)
            dh = (dz * a + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
            grad = {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (da * t * g).sum(0), "c": f["z"].T @ dp, "d": dp.sum()}
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k in w:
                gr = grad[k] + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.999 * second[k] + 0.001 * gr * gr
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents with a quality label (0 or 1), of those where ``train_on`` holds; repeated labels of an id are averaged and rounded."""
    lab = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    if train_on is not None:
        lab = lab.filter(train_on)
    n = lab.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    d = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)).join(chosen, "doc_id")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bags = [encode(t) for t in texts_of(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary())], ["doc_id", "quality", "bag"])

    # bounded by FIT_ROWS documents
    rows = map_arrow(d.select("doc_id", "text", "quality"), run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, quality int, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES).astype(np.float32) for x in rows["bag"].to_pylist()]
    return train(bags, rows["quality"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, top_passage) of every row."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(b, "text")
        for i in range(0, len(texts), 256):
            p, a = model.score(texts[i : i + 256])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(p), pa.array([len(x) for x in a], pa.int32()), pa.array([int(x.argmax()) for x in a], pa.int32())], ["doc_id", "score", "n_passages", "top_passage"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_passages int, top_passage int")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage).

    Fitted where the crc32 of the id leaves other than 2 by four. A null or
    empty text is one empty passage and is scored; without labels of both
    kinds each score is the smoothed share of label 1.
    """
    model = fit(docs, labels, crc_rest("doc_id", 4) != 2)
    held = F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_passages", "top_passage")
