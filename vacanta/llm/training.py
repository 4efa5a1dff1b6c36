"""Bounded samples of labelled texts, for models that the driver trains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, utf8

#: Labelled documents of each class that a model learns from, and the bytes of the
#: longest that is taken: a sample has at most 2 * PER_CLASS * LONGEST bytes.
PER_CLASS, LONGEST = 2_000, 32_768


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS, longest: int = LONGEST) -> tuple[list[bytes], np.ndarray]:
    """UTF-8 texts and 0/1 labels outside the held-out fifth, the same for the same tables.

    Which rows are taken depends on a hash of doc_id alone. Rows without doc_id or label
    are not taken, nor are labels of documents that ``docs`` lacks.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    order = (F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id"))
    chosen = [known.filter(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
    found = rows.join(F.broadcast(chosen), "doc_id").toPandas()  # the hint's side has 2 * per_class rows at most
    found = found.sort_values(["doc_id", "text"])
    return list(utf8(found["text"])), found["label"].to_numpy(dtype=np.float64)


class Adam:
    """Steps for a list of arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(p.dtype)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
