"""Toxicity by subword-bag embeddings and a linear softmax (operator 9).

A word is the mean of the embeddings of its character n-grams (hashed bytes, word ends
marked; longer ones from the word's start only), and a linear softmax gives its odds of
being toxic. Misspelt words share most n-grams with the words they come from. Toxic texts
are taken as a mixture: a word comes with probability ``SHARE`` from the toxic words, else
from the others, so a word's evidence is ``log(1 - SHARE + SHARE * odds)``. In training a
document's logit is the sum of its words' evidence, and embeddings and softmax are
trained together on document labels, on the driver, on a bounded sample (at most
``PER_CLASS`` labelled texts a class, none longer than ``training.LONGEST`` bytes).

A document's score is that of its most toxic stretch: the largest sum of evidence over
words in a row, found in one scan of the whole text, so neither the length of a text nor
clean words around a toxic passage hide it. Its logarithm is scaled on documents that the
training left out.

Defined results: null, empty and blank texts have no evidence and score as clean ones;
texts of any length are read whole, a part at a time, and the parts do not show; rows that
repeat score alike; without usable labels of both classes all scores are 0; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_values, table
from .training import Adam, labelled_texts, sigmoid

PER_CLASS = 800
#: Lengths of n-grams anywhere in a word, and of those at its start only.
SIZES, EDGES = (3, 4, 5), (6, 7, 8)
BUCKET_BITS, DIM = 17, 4
#: Share of toxic words in a toxic text.
SHARE = 0.02
#: How far the embedding of the most telling n-gram moves in a step; documents that
#: smooth the first log-odds.
STEPS, RATE, PRIOR = 100, 0.1, 3.0
THRESHOLD = 0.5
#: Bytes of text that are scored at once.
PART = 1 << 20
# ASCII characters that end a word; @ $ * and digits stand for letters at times.
_ENDS = b"\t\n\x0b\x0c\r !\"#%&'()+,-./:;<=>?[\\]^_`{|}~"
_TABLE = bytes(32 if c in _ENDS or c < 32 else c for c in range(256))


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that begin and end with a space."""
    space = raw == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edges[::2], edges[1::2]


def ngram_buckets(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, bucket, valid) for each start of n bytes; valid: at most the ends are spaces."""
    h, solid = raw[:-1].astype(np.uint32) * np.uint32(0x01000193) + raw[1:], np.ones(len(raw), dtype=bool)
    inner = raw != 32
    for n in range(3, EDGES[-1] + 1):
        m = len(raw) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + raw[n - 1 :]
        solid = solid[:m] & inner[n - 2 : n - 2 + m]
        x = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        x = x * np.uint32(0x85EBCA6B)
        yield n, (x >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), solid if n in SIZES else solid & ~inner[:m]


def evidence(logits: np.ndarray) -> np.ndarray:
    """Log of how much likelier a word is in a toxic text, from its log-odds."""
    return np.logaddexp(np.log(1 - SHARE), np.log(SHARE) + logits)


class Model:
    """Scores of buckets (the softmax's difference of each embedding) and a scaling."""

    def __init__(self, bucket: np.ndarray, bias: float, scale: float, shift: float):
        self.bucket, self.bias, self.scale, self.shift = bucket, bias, scale, shift

    def word_logits(self, data: bytes) -> np.ndarray:
        """A number for each word: the mean over its n-grams."""
        raw = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
        start, end = bounds(raw)
        total, count = np.zeros(len(start)), np.zeros(len(start))
        for n, bucket, valid in ngram_buckets(raw):
            if n in SIZES:
                run = np.zeros(len(bucket) + 1)
                np.cumsum(self.bucket[bucket], out=run[1:])
                first = np.minimum(start - 1, len(bucket))
                last = np.minimum(np.maximum(end + 2 - n, first), len(bucket))
                total += run[last] - run[first]
                count += last - first
            else:
                at = np.minimum(start - 1, len(bucket) - 1)
                held = valid[at] & (start - 1 < len(bucket))
                total += np.where(held, self.bucket[bucket[at]], 0)
                count += held
        return total / np.maximum(count, 1) + self.bias

    def worst(self, text: str | None) -> float:
        """The largest sum of evidence over words in a row, 0 at least."""
        data, most, open_run, at = normal(text), 0.0, 0.0, 0
        while at < len(data):
            stop = data.find(b" ", at + PART)
            stop = len(data) if stop < 0 else stop
            words = self.word_logits(data[at:stop])
            if len(words):
                # the run that was open goes on across the cut
                total = open_run + np.concatenate(([0.0], np.cumsum(evidence(words))))
                low = np.minimum(np.minimum.accumulate(total), 0.0)
                most, open_run = max(most, float((total - low).max())), float(total[-1] - low[-1])
            at = max(stop, at + 1)
        return most

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.scale * np.log1p(self.worst(text)) + self.shift))


class _Bags:
    """Means of rows of a table by group, and the gradient back to the table, a column at a time."""

    def __init__(self, group: np.ndarray, item: np.ndarray, n_groups: int, n_items: int):
        self.item, self.count = item, np.bincount(group, minlength=n_groups).astype(np.float32)
        self.first = np.searchsorted(group, np.arange(n_groups, dtype=group.dtype))
        order = np.argsort(item, kind="stable")
        self.back = group[order]
        items = item[order]
        del order
        self.starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        self.touched, self.n_items = items[self.starts], n_items

    def mean(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.count), rows.shape[1]), dtype=np.float32)
        for d in range(rows.shape[1]):
            out[:, d] = np.add.reduceat(np.ascontiguousarray(rows[:, d])[self.item], self.first) / self.count
        return out

    def gradient(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_items, grad.shape[1]), dtype=np.float32)
        for d in range(grad.shape[1]):
            out[self.touched, d] = np.add.reduceat((grad[:, d] / self.count).astype(np.float32)[self.back], self.starts)
        return out


def _documents_with(grams: _Bags, word: np.ndarray, n_words: int) -> np.ndarray:
    """For each bucket about how many documents hold it, from the words of each document."""
    per_word = np.bincount(word, minlength=n_words).astype(np.float32)
    return (grams.gradient((per_word * grams.count)[:, None]))[:, 0]


def train(texts: list[str | bytes], label: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    nothing = Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0, 0.0, -40.0)
    if len(set(label.tolist())) < 2:
        return nothing
    texts = [normal(t.decode("utf-8", "surrogatepass") if isinstance(t, bytes) else t) for t in texts]
    rng = np.random.default_rng(seed)
    aside = rng.random(len(texts)) < 0.25
    for y in (0, 1):  # some of each class on either side
        of = np.flatnonzero(label == y)
        aside[of[0]], aside[of[-1]] = False, len(of) > 1
    # words of the training documents, with their counts
    vocabulary: dict[bytes, int] = {}
    doc, word, times = [], [], []
    for d in np.flatnonzero(~aside):
        w, n = np.unique(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in texts[d].split()], dtype=np.int32), return_counts=True)
        doc.append(np.full(len(w), d, dtype=np.int32))
        word.append(w)
        times.append(n)
    if not vocabulary:
        return nothing
    doc, word, times = np.concatenate(doc), np.concatenate(word), np.concatenate(times)
    raw = np.frombuffer(b" " + b" ".join(vocabulary) + b" ", dtype=np.uint8)
    owner = (np.cumsum((raw[:-1] == 32) & (raw[1:] != 32)) - 1).astype(np.int32)
    parts = [(owner[np.flatnonzero(v)], b[v]) for _, b, v in ngram_buckets(raw)]
    group, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del raw, owner, parts
    order = np.argsort(group, kind="stable")
    grams = _Bags(group[order], bucket[order], len(vocabulary), 1 << BUCKET_BITS)
    del group, bucket, order

    # The first coordinate starts as each n-gram's smoothed log-odds over documents, so that
    # toxic words are already found in the first step; the others start near 0.
    df = [_documents_with(grams, word[label[doc] == c], len(vocabulary)) for c in (0, 1)]
    n = [len(np.unique(doc[label[doc] == c])) for c in (0, 1)]
    embedding = rng.normal(0, 1e-2, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    odds = np.log((df[1] + PRIOR) / (n[1] + 2 * PRIOR)) - np.log((df[0] + PRIOR) / (n[0] + 2 * PRIOR))
    embedding[:, 0] += np.where(df[0] + df[1] > 0, odds, 0)
    out, bias, base = np.zeros((DIM, 2), dtype=np.float32), np.array([1, -1], dtype=np.float32), np.zeros(1)
    out[0], out[1:] = (-1, 1), rng.normal(0, 0.5, (DIM - 1, 2))
    pace, step = np.zeros_like(embedding), Adam([out, bias, base], 0.05)
    weigh = ~aside * np.where(label == 1, 0.5 / max((label * ~aside).sum(), 1), 0.5 / max(((1 - label) * ~aside).sum(), 1))
    for _ in range(steps):
        hidden = grams.mean(embedding)
        logits = hidden @ out + bias
        odds = (logits[:, 1] - logits[:, 0]).astype(np.float64)
        total = np.bincount(doc, weights=times * evidence(odds)[word], minlength=len(texts)) + base[0]
        miss = (sigmoid(total) - label) * weigh
        guilty = sigmoid(odds + np.log(SHARE / (1 - SHARE)))  # how likely a word comes from the toxic ones
        delta = (np.bincount(word, weights=times * miss[doc], minlength=len(vocabulary)) * guilty).astype(np.float32)
        grad = np.stack([-delta, delta], axis=1)
        # steps go by the root of the gradient: an n-gram of few documents moves less, yet it moves
        down = grams.gradient(grad @ out.T)
        size = np.abs(down)
        pace = 0.7 * pace + 0.3 * np.sign(down) * np.sqrt(size / (size.max() + 1e-12))
        embedding -= RATE * pace
        step.step([hidden.T @ grad + 1e-5 * out, grad.sum(axis=0), np.array([miss.sum()])])
    model = Model((embedding @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    rest = np.flatnonzero(aside)
    model.scale, model.shift = platt(np.log1p([model.worst(texts[i].decode("utf-8", "surrogatepass")) for i in rest]), label[rest])
    return model


def platt(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression, with smoothed targets."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    target, weight = np.where(y == 1, (n1 + prior) / (n1 + 2 * prior), prior / (n0 + 2 * prior)), 1 / len(y)
    centre, width = float(np.median(x)), float(x.std()) or 1.0
    z, a, b = (x - centre) / width, 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z * weight).sum() + 1e-4 * a, ((p - target) * weight).sum()])
        w = np.maximum(p * (1 - p), 1e-6) * weight
        h = np.array([[(w * z * z).sum() + 1e-4, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(a - da, 1e-3), b - db
    return a / width, b - a * centre / width


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    return apply_model(docs, train(*labelled_texts(docs, labels, "toxic", PER_CLASS)), threshold)


def apply_model(docs: DataFrame, model, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted by ``model.score`` of whole texts."""
    scored = map_values(docs.select("doc_id", "text"), "text", lambda: lambda t: (model.score(t),), "score double")
    mine = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", mine.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
