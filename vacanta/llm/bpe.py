"""Byte-level BPE over whole texts, and back (operator 4).

Each distinct word of a batch (a match of the pattern) is folded once: of all adjacent
pieces, the pair of the lowest rank merges first, the leftmost of equals, until no pair
has a rank. Texts are then put together from the words' ids. Decoding concatenates the
ids' byte pieces.

The fold runs in Python workers, not in Spark's higher-order functions; the README
tells why, with figures.

Defined results: null and empty texts have no ids; any text decodes to its own UTF-8
bytes; texts of any length are encoded whole; rows that repeat are each returned; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_values, table

#: Words that a worker keeps folded; beyond this it starts anew.
KEPT_WORDS = 600_000

# Letters, numbers and white space among the characters up to U+024F, for
# which the pattern of public_tokenizers is written without Unicode classes. Texts with
# other characters take the pattern itself.
_LETTERS, _NUMBERS, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_OTHER = re.compile("[^\t-\r -~\x85\xa0-ɏ]")


def _plain(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts of those characters only, or None if it can't be written so."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_WHITE}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]")
    out = out.replace(r"\p{N}", f"[{_NUMBERS}]").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
    return None if "\\" in out.replace("\\t", "").replace("\\r", "").replace("\\x", "") else re.compile(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, by ranked merges."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    pieces = [word[i : i + 1] for i in range(len(word))]
    rank = ranks.get
    if len(pieces) > 128:
        return _fold_long(word, ranks)
    pairs = [rank(pieces[i] + pieces[i + 1]) for i in range(len(pieces) - 1)]
    while True:
        at, best = -1, None
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                at, best = i, r
        if best is None:
            return [ranks[p] for p in pieces]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = rank(pieces[at - 1] + pieces[at])
        if at < len(pairs):
            pairs[at] = rank(pieces[at] + pieces[at + 1])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and linked pieces: n log n for words of any length."""
    import heapq

    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes texts by a rank file and a pattern that splits them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.kept = ranks, {}
        self.any_text = regex.compile(pattern).findall
        self.plain_text = found.findall if (found := _plain(pattern)) else self.any_text
        self.pieces = {i: p for p, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found, kept = (self.any_text if _OTHER.search(text) else self.plain_text)(text), self.kept
        try:
            return b"".join(map(kept.__getitem__, found))
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in set(found):
                if w not in kept:
                    kept[w] = np.array(fold(w.encode("utf-8"), self.ranks), dtype="<u4").tobytes()
            return b"".join([kept[w] for w in found])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: One codec for each rank file and pattern in a worker, so that later tasks find the words kept.
_CODECS: dict[tuple[str, str], Codec] = {}


def worker_codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes; ids and bytes too if wanted."""

    def make():
        codec = worker_codec(path, pattern)

        def row(text: str | None) -> tuple:
            ids = codec.encode(text or "")
            back = codec.decode(ids)
            digests = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
            return (*digests, ids, back) if keep_ids else digests

        return row

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_values(docs.select("doc_id", "text"), "text", make, ddl + (", ids binary, decoded binary" if keep_ids else ""))


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
