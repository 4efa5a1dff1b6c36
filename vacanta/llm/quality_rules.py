"""Quality rules: lines labelled by a linear-chain conditional random field (operator 8).

Every line has a few binary features; a chain of two labels, content and boilerplate,
is trained on the driver on a bounded sample of labelled documents (a document's label
stands for its lines; at most ``PER_CLASS`` a class, none longer than ``training.LONGEST``
bytes), a batch of chains of like length at a time, and Viterbi decoding labels the lines of every document. A
document is kept if at least ``SHARE`` of its word characters lie on content lines and
it does not fail the base rules.

Defined results: null and empty texts have no words and fail the base rules; rows that
repeat are judged alike; texts of any length are judged whole; without usable labels of both classes all lines are content; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_values, mix, table, utf8, word_hashes
from .training import Adam, labelled_texts

MIN_WORDS, REPEAT_PERCENT, SHARE = 50, 50, 0.5
#: Documents of each class that the field is trained on.
PER_CLASS = 800
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ENDS = re.compile(rb"[.!?:;][\"')\]]*[\x20\x09-\x0D]*\Z")
N_FEATURES = 14
#: Lines, with those that pad chains to one length, that training has in memory at once.
CELLS = 1 << 17
#: The features of each set of features, written as bits.
FEATURES = ((np.arange(1 << N_FEATURES)[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float32)


def repeated_words(word: np.ndarray) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(word) < 4:
        return 0
    odd = np.uint64(0x9E3779B97F4A7C15)
    window = mix(mix(mix(word[:-2]) * odd + word[1:-1]) * odd + word[2:])
    _, back, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    marked = np.zeros(len(word), dtype=bool)
    for i in range(3):
        marked[i : len(word) - 2 + i] |= twice
    return int(marked.sum())


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each line as bits, and the bytes of each line's words."""
    out, weight, seen = np.zeros((len(lines), N_FEATURES), dtype=bool), np.zeros(len(lines)), set()
    for i, line in enumerate(lines):
        w = line.split()
        n, f = len(w), out[i]
        f[0] = 1
        if not n:
            f[1] = 1
            continue
        size = sum(map(len, w))
        weight[i] = size
        f[2], f[3], f[4] = n < 4, 4 <= n < 12, n >= 12
        f[5] = bool(_ENDS.search(line))
        upper = size - len(line.translate(None, _UPPER).translate(None, b" \t\n\x0b\x0c\r"))
        lower = size - len(line.translate(None, _LOWER).translate(None, b" \t\n\x0b\x0c\r"))
        f[6] = upper > lower
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        f[7], f[8] = 10 * symbols > n, 2 * symbols > n
        f[9] = 4 * line.count(b"!") > n
        f[10] = 5 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > n
        f[11] = n >= 12 and 2 * len(set(w)) < n
        f[12] = line in seen
        f[13] = size > 14 * n
        seen.add(line)
    return out @ (1 << np.arange(N_FEATURES, dtype=np.int32)), weight


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The most likely labels (0 boilerplate, 1 content) of one chain; ties give content."""
    if not len(emission):
        return np.zeros(0, dtype=int)
    (t00, t01), (t10, t11) = transition.tolist()
    rows = emission.tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((from0, from1))
        a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
    label = [int(b >= a)]
    for step in reversed(back):
        label.append(int(step[label[-1]]))
    return np.array(label[::-1])


def batches(lengths: np.ndarray) -> list[slice]:
    """Runs of chains, longest first, that padded to the first one's length stay within CELLS."""
    out, at = [], 0
    while at < len(lengths):
        n = max(1, CELLS // max(int(lengths[at]), 1))
        out.append(slice(at, min(at + n, len(lengths))))
        at += n
    return out


def gradients(chains: list[np.ndarray], label: np.ndarray, weigh: np.ndarray, weights: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighed negative log-likelihood of some chains, longest first."""
    n, longest = len(chains), len(chains[0])
    flat, both = np.concatenate(chains), np.eye(2)[label]
    at = np.concatenate([np.arange(len(c)) for c in chains]), np.repeat(np.arange(n), [len(c) for c in chains])
    mask = np.zeros((longest, n))
    mask[at] = 1
    alive = mask.sum(axis=1).astype(int)  # chains are in descending length: the first ones are alive
    e = np.zeros((longest, n, 2))
    e[at] = (FEATURES @ weights)[flat]
    alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
    alpha[0] = e[0]
    for t in range(1, longest):
        k = alive[t]
        alpha[t, :k] = np.logaddexp(alpha[t - 1, :k, :1] + transition[0], alpha[t - 1, :k, 1:] + transition[1]) + e[t, :k]
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        on = beta[t + 1, :k] + e[t + 1, :k]
        beta[t, :k] = np.logaddexp(on[:, :1] + transition[:, 0], on[:, 1:] + transition[:, 1])
    z = np.logaddexp(*(alpha + beta).transpose(2, 0, 1))
    marginal = np.exp(alpha + beta - z[..., None]) * mask[..., None]
    delta = ((marginal - both[None] * mask[..., None]) * weigh[:, None])[at]
    by_line = np.stack([np.bincount(flat, weights=delta[:, y], minlength=len(FEATURES)) for y in (0, 1)], axis=1)
    pair = alpha[:-1, :, :, None] + transition + (e + beta)[1:, :, None, :] - z[1:, :, None, None]
    pair = np.exp(np.minimum(pair, 0)) * mask[1:, :, None, None]
    want = both[:, :, None] * both[:, None, :]
    grad_t = ((pair - want[None] * mask[1:, :, None, None]) * weigh[:, None, None]).sum(axis=(0, 1))
    return FEATURES.T @ by_line, grad_t


def train_crf(texts: list[bytes], label: np.ndarray, steps: int = 80, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 2) and transitions by gradient descent on the log-likelihood."""
    weights, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len(set(label.tolist())) < 2:
        weights[0] = 0, 1
        return weights, transition
    chains = [line_features(t.split(b"\n"))[0].astype(np.int16) for t in texts]
    order = np.argsort([-len(c) for c in chains], kind="stable")
    chains, label = [chains[i] for i in order], label[order].astype(int)
    lengths = np.array([len(c) for c in chains])
    weigh = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / lengths
    step, parts = Adam([weights, transition], rate), batches(lengths)
    for _ in range(steps):
        found = [gradients(chains[p], label[p], weigh[p], weights, transition) for p in parts]
        step.step([sum(g[i] for g in found) / len(chains) + 1e-4 * x for i, x in enumerate((weights, transition))])
    return weights, transition


def judge(data: bytes, emission: np.ndarray, transition: np.ndarray) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share, labels."""
    word, lines = word_hashes(data), data.split(b"\n")
    solid = data.translate(None, b" \t\n\x0b\x0c\r")
    n_words, word_chars = len(word), len(solid.decode("utf-8", "surrogatepass"))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    filled = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    repeats = repeated_words(word)
    failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    features, weight = line_features(lines)
    label = viterbi(emission[features], transition)
    share = float((weight * label).sum() / weight.sum()) if weight.sum() else 0.0
    return n_words, word_chars, n_symbols, len(filled) - len(set(filled)), repeats, failed, not failed and share >= SHARE, share, label.tolist()


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, verdicts, content share and line labels of every row of ``docs`` (doc_id, text)."""
    weights, transition = train_crf(*labelled_texts(docs, labels, "quality", PER_CLASS))
    emission = FEATURES @ weights
    return map_values(
        docs.select("doc_id", "text"),
        "text",
        lambda: lambda t: judge(next(utf8([t])), emission, transition),
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double, line_labels array<int>",
    )


def op8_quality_rules(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("line_labels")
