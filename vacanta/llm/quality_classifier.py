"""Quality by random-indexing word vectors and a two-layer network (operator 1).

Every word has a fixed sparse random index vector, found from its hash. Over the training
texts a word's context vector gathers the index vectors of its neighbours; a word never
met there has its index vector alone. A document is the mean of its words' vectors, the
mean of the index vectors of its words' traits (shape, and whether the word, or it with
the two before, came earlier in the text), how long these means are, and how many words
there are. A network of one hidden layer, trained with numpy, and a temperature fitted on
documents that the training left out turn that into a probability.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled texts a class, none
longer than ``training.LONGEST`` bytes. Every text is scored whole.

Defined results: null and empty texts have no words and score as the network says of
zeros; texts of any length are read whole; rows that repeat score alike; without usable labels of both classes all scores are
the share of label 1, or 0.5 without labels; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import BLOCK, mix, prefix_hashes, slice_hashes, table, utf8, words
from .toxicity import apply_model
from .training import Adam, labelled_texts, sigmoid

PER_CLASS = 1_000
DIM, NONZERO, BUCKET_BITS = 32, 4, 15
NEIGHBOURS = 2
HIDDEN, STEPS, RATE = 24, 300, 0.02
THRESHOLD = 0.3
N_TRAITS = 16


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors, the same ones everywhere: NONZERO entries of +1 or -1 each."""
    out = np.zeros((n, DIM), dtype=np.float32)
    for k in range(NONZERO):
        h = mix(np.arange(n, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k) + np.uint64(seed << 32))
        np.add.at(out, (np.arange(n), (h >> np.uint64(40)) % np.uint64(DIM)), np.where(h & np.uint64(1), 1, -1))
    return out / np.sqrt(NONZERO)


_CLASSES = np.zeros((4, 256), dtype=np.int32)
_CLASSES[0, 65:91] = 1  # upper case
_CLASSES[1, 48:58] = 1  # digits
_CLASSES[2, list(b"#*$%&|<>@^~_=+\\/{}[]")] = 1  # symbols
_CLASSES[3, list(b"!?")] = 1
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,;:!?")] = True


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and a 0/1 row of traits for each."""
    start, end = words(data)
    n = len(start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros((0, N_TRAITS), dtype=np.float32)
    raw, h = np.frombuffer(data, dtype=np.uint8), np.empty(n, dtype=np.uint64)
    count, first = np.empty((4, n), dtype=np.int64), 0
    while first < n:
        last = max(int(np.searchsorted(end, start[first] + BLOCK, "right")), first + 1)
        at, part = start[first], slice(first, last)
        piece = raw[at : end[last - 1]]
        h[part] = slice_hashes(prefix_hashes(piece), start[part] - at, end[part] - at)
        for i in range(4):
            run = np.concatenate(([0], np.cumsum(_CLASSES[i][piece])))
            count[i, part] = run[end[part] - at] - run[start[part] - at]
        first = last
    size = end - start
    upper, digits, symbols, marks = count
    traits = np.zeros((n, N_TRAITS), dtype=np.float32)
    traits[:, 0], traits[:, 1], traits[:, 2], traits[:, 3] = size <= 3, (size > 3) & (size <= 7), (size > 7) & (size <= 12), size > 12
    traits[:, 4], traits[:, 5] = (upper > 1) & (2 * upper > size), upper == 1
    traits[:, 6], traits[:, 7], traits[:, 8] = digits > 0, symbols > 0, 2 * symbols >= size
    traits[:, 9], traits[:, 10] = marks > 1, _STOPS[raw[end - 1]]
    traits[1:, 11] = h[1:] == h[:-1]
    order = np.argsort(h, kind="stable")
    again = np.zeros(n, dtype=bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    traits[:, 12] = again
    if n > 3:
        odd = np.uint64(0x9E3779B97F4A7C15)
        three = mix(mix(h[:-2] * odd + h[1:-1]) * odd + h[2:])
        order = np.argsort(three, kind="stable")
        traits[2 + order[1:], 13] = three[order[1:]] == three[order[:-1]]
    traits[2:, 14] = h[2:] == h[:-2]
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), traits


def context_vectors(texts: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Index vectors plus the mean index vector of the neighbours met in ``texts``, of length 1."""
    total, met = np.zeros_like(index, dtype=np.float64), np.zeros(len(index))
    for bucket in texts:
        for gap in range(1, NEIGHBOURS + 1):
            if len(bucket) > gap:
                for a, b in ((bucket[gap:], bucket[:-gap]), (bucket[:-gap], bucket[gap:])):
                    order = np.argsort(a, kind="stable")
                    at, first = np.unique(a[order], return_index=True)
                    total[at] += np.add.reduceat(index[b[order]], first, axis=0)
                    met[at] += np.diff(np.append(first, len(a)))
    out = index + total / np.maximum(met, 1)[:, None]
    return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]).astype(np.float32)


class Model:
    """Pooling and network; ``share`` answers where nothing could be learnt."""

    def __init__(self, vectors: np.ndarray, share: float = 0.5):
        self.vectors, self.traits, self.share = vectors, index_vectors(N_TRAITS, 2), share
        self.layers, self.temperature, self.centre, self.width = None, 1.0, 0.0, 1.0

    def pooled(self, data: bytes) -> np.ndarray:
        bucket, traits = features(data)
        if not len(bucket):
            return np.zeros(2 * DIM + 3)
        word = np.bincount(bucket, minlength=len(self.vectors))
        at = np.flatnonzero(word)
        mean = word[at].astype(np.float32) @ self.vectors[at] / len(bucket)
        trait = traits.mean(axis=0) @ self.traits
        return np.concatenate([mean, trait, [np.linalg.norm(mean), np.linalg.norm(trait), np.log1p(len(bucket)) / 10]])

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.centre) / self.width @ a + b) @ c + d

    def score(self, text: str | None) -> float:
        if self.layers is None:
            return self.share
        x = self.pooled(next(utf8([text])))
        return float(sigmoid(self.logit(x[None]) / self.temperature)[0])


def train(texts: list[bytes], label: np.ndarray, seed: int = 3) -> Model:
    index = index_vectors(1 << BUCKET_BITS, 1)
    if len(set(label.tolist())) < 2:
        return Model(index, float(label.mean()) if len(label) else 0.5)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(texts)) < 0.25
    for y in (0, 1):
        of = np.flatnonzero(label == y)
        aside[of[0]], aside[of[-1]] = False, len(of) > 1
    model = Model(context_vectors([features(t)[0] for t, a in zip(texts, aside, strict=True) if not a], index))
    x = np.array([model.pooled(t) for t in texts])
    model.centre, model.width = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    z, y = (x - model.centre) / model.width, label
    layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    weight = np.where(y == 1, 0.5 / y[~aside].mean(), 0.5 / (1 - y[~aside].mean()))
    step, t, g, w = Adam(layers, RATE), z[~aside], y[~aside], weight[~aside]
    for _ in range(STEPS):
        hidden = np.tanh(t @ layers[0] + layers[1])
        delta = (sigmoid(hidden @ layers[2] + layers[3]) - g) * w / len(g)
        back = delta[:, None] * layers[2] * (1 - hidden * hidden)
        step.step([t.T @ back + 1e-3 * layers[0], back.sum(axis=0), hidden.T @ delta + 1e-3 * layers[2], delta.sum()])
    model.layers = layers
    logits, target, w = model.logit(x[aside]), y[aside], weight[aside]
    grid = np.geomspace(0.25, 8, 61)
    soft = (target * len(target) + 1) / (len(target) + 2)  # else the temperature of a clean split is 0
    loss = [(w * (soft * np.logaddexp(0, -logits / k) + (1 - soft) * np.logaddexp(0, logits / k))).sum() for k in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    return apply_model(docs, train(*labelled_texts(docs, labels, "quality", PER_CLASS)), threshold)


def op1_quality(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
