"""Packing by lexical retrieval (operator 7).

Documents are cut into tokens. A document that fills windows by itself does so; what is
left of each document is a unit. Units are put in the order of their rarest terms, by the
counts of the whole corpus, and dealt into shards of neighbours in that order, about
``SHARD_TOKENS`` each. A shard has a BM25 inverted index, with the corpus's counts, which
returns for each seed (the longest unused unit) its best unused neighbours by all terms
that tell; these fill the seed's window in that order, and where the seed has none left,
the next longest units follow. The last unit of a window is cut where the window ends, and
its rest stays unused. What a shard has left over at its end is cut into powers of two,
which need no padding.

So texts that share their rarest terms (copies, edited copies, quotations) meet wherever
they lie, and time grows with the corpus; a neighbour that shares only commoner terms may
lie in another shard. The README tells how many do. A task holds two shards at most, and
a key that very many units have (copies of one text) is dealt over shards like any other.

Defined results: a null or empty text is a document of the end id alone; strings of
special tokens in a text are those tokens, as the library has them; rows that repeat are
each packed; ties go by the order in the shard; texts of any length are read whole, and
only what fills no window goes into a shard; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, small_batches, table

WINDOW, END_ID = 4_096, 2
#: Tokens of a shard, shards of a partition, and the most partitions (beyond, they grow).
SHARD_TOKENS, PART_SHARDS, MOST_PARTS = 1 << 20, 4, 1 << 16
#: Rarest terms that order the units.
KEY_TERMS = 4
#: Units sampled for each partition, to find where the partitions' ranges end.
SAMPLED = 32
#: BM25's constants, words kept encoded, and words looked up together (or those of a longer text).
K1, B = 1.2, 0.75
KEPT_WORDS, WORDS_AT_ONCE = 800_000, 1 << 16

# The word pattern of the tokenizer for texts of characters up to U+012F,
# where lower-casing and composition need no more than Python's; others take the tokenizer.
_LETTERS, _NUMBERS, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-į", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\t-\r -~\x85\xa0-į]")
_PLAIN = bytes([*range(9, 14), *range(32, 127)])


def _is_other(text: str) -> bool:
    """Whether ``text`` holds characters that are the library's own business."""
    return bool(text.encode().translate(None, _PLAIN)) if text.isascii() else bool(_OTHER.search(text))


class Merges:
    """A tokenizer's ranked merges, done on many words at once: in each step every word has
    the leftmost of its pairs of least rank merged."""

    NONE, LONGEST = np.int64(1 << 62), 255

    def __init__(self, path: str, suffix: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        #: Ids of a byte within a word and at its end; ``none`` is no token.
        self.inner, self.last = (np.array([vocab[letter[b] + end] for b in range(256)]) for end in ("", suffix))
        self.none = self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges])
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.made = pair[order], order, np.array([vocab[a + b] for a, b in merges])

    def _keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of pairs in one number; NONE for those that don't merge."""
        pair = a * self.size + b
        at = np.searchsorted(self.pair, pair)
        at[at == len(self.pair)] = 0
        return np.where((self.pair[at] == pair) & (b != self.none), self.rank[at] << 8 | place, self.NONE)

    def ids(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all words, of at most LONGEST bytes each, and where each word's end in them."""
        data = np.frombuffer((" ".join(words) + " ").encode(), dtype=np.uint8)
        end = np.flatnonzero(data == 0x20)
        start = np.concatenate(([0], end[:-1] + 1))
        token, after, before = self.inner[data], np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        token[end - 1] = self.last[data[end - 1]]
        token[end] = self.none
        alive = token != self.none
        place = np.arange(len(data)) - np.repeat(start, end + 1 - start)
        key = np.full(len(data), self.NONE)
        key[:-1] = self._keys(token[:-1], token[1:], place[:-1])
        while True:
            best = np.minimum.reduceat(key, start)
            some = np.flatnonzero(best != self.NONE)
            if not len(some):
                break
            best = best[some]
            at = start[some] + (best & 0xFF)
            gone = after[at]
            nxt, prior = after[gone], before[at]
            token[at], alive[gone], key[gone] = self.made[best >> 8], False, self.NONE
            after[at], before[nxt] = nxt, at
            key[at] = self._keys(token[at], token[nxt], place[at])
            key[prior] = self._keys(token[prior], token[at], place[prior])
        return token[alive].astype("<u4").tobytes(), (4 * np.cumsum(np.add.reduceat(alive, start, dtype=np.int64))).tolist()


class WordTokenizer:
    """Ids of texts by a tokenizer file; words met before are looked up.

    ``kept`` has the words met of late; when it is half full it becomes ``older``, from
    which what is met again comes back, so only words that stay away are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.older = Tokenizer.from_file(path), {}, {}
        self.merges = Merges(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # texts that may hold a special token are the library's own business
        self.special = re.compile("|".join(map(re.escape, special)) or r"\Z.", re.I)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.small = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        """Keeps the ids of words."""
        start, known = 0, [w for w in words if len(w) <= Merges.LONGEST // 4]
        for w in words if len(known) < len(words) else ():
            if len(w) > Merges.LONGEST // 4:
                self.kept[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if known:
            raw, ends = self.merges.ids(known)
            for w, end in zip(known, ends, strict=True):
                self.kept[w] = raw[start:end]
                start = end

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; texts that follow one another are looked up together."""
        group, size = [], 0
        for text in texts:
            if _is_other(text) or self.special.search(text):
                group.append((np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"), (), ()))
            else:
                # words do not cross white space, so what stands between it is looked up as one
                found = text.lower().split()
                raw = list(map(self.kept.get, found))
                at = [i for i, ids in enumerate(raw) if ids is None] if None in raw else ()
                group.append((raw, at, [found[i] for i in at]))
            size += len(group[-1][0])
            if size >= WORDS_AT_ONCE:
                yield from self._filled(group)
                group, size = [], 0
        yield from self._filled(group)

    def _filled(self, group: list[tuple]) -> Iterator[np.ndarray]:
        """The ids of texts, for each of which ``group`` has the ids of its chunks, the places
        of those that were not found and these; or an array of ids."""
        if len(self.kept) > KEPT_WORDS // 2:
            self.kept, self.older = {}, self.kept
        new = self._met(set(chain.from_iterable(chunks for _, _, chunks in group)))
        for raw, at, chunks in group:
            if isinstance(raw, np.ndarray):
                yield raw
                continue
            for i, chunk in zip(at, chunks, strict=True):
                raw[i] = new[chunk]
            yield np.frombuffer(b"".join(raw), dtype="<u4")

    def _met(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that ``kept`` lacks; it gets their words, and chunks that may come again."""
        kept, older, new = self.kept, self.older, {}
        for chunk in chunks:
            if chunk in older:
                kept[chunk] = new[chunk] = older[chunk]
            else:
                new[chunk] = (chunk,) if chunk.isalpha() else _WORD.findall(chunk)
        parted = {chunk: parts for chunk, parts in new.items() if not isinstance(parts, bytes)}
        words = set(chain.from_iterable(parted.values())).difference(kept)
        for w in [w for w in words if w in older]:
            kept[w] = older[w]
            words.remove(w)
        if words:
            self.learn(list(words))
        for chunk, parts in parted.items():
            if len(parts) == 1:
                new[chunk] = kept[parts[0]]
            else:
                new[chunk] = b"".join(map(kept.__getitem__, parts))
                if words.isdisjoint(parts):  # all its words were met before, so it may come again
                    kept[chunk] = new[chunk]
        return new


#: One tokenizer for each file in a worker, so that later tasks find the words kept.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Index:
    """BM25 postings of some units in one array, ordered by term.

    Counts of units, tokens and holders of each term are those of the whole ``corpus`` (units,
    tokens, holders by term), so scores do not depend on which units an index holds; without
    it they are those of the units. Scores are rounded, so that no order of sums shows.
    """

    def __init__(self, units: list[np.ndarray], corpus: tuple[int, int, np.ndarray] | None = None):
        sizes = np.array([len(u) for u in units])
        terms, owner = np.concatenate(units).astype(np.int64), np.repeat(np.arange(len(units)), sizes)
        pairs, tf = np.unique(terms * len(units) + owner, return_counts=True)
        self.owner, term = pairs % len(units), pairs // len(units)
        self.terms, self.first, self.held = np.unique(term, return_index=True, return_counts=True)
        n, tokens, df = (len(units), int(sizes.sum()), self.held) if corpus is None else (corpus[0], corpus[1], corpus[2][self.terms])
        # a term of over half of the units tells nothing
        self.idf = np.where(2 * df > n, 0, np.log(1 + (n - df + 0.5) / (df + 0.5)))
        norm = K1 * (1 - B + B * sizes * n / tokens)
        self.score = np.repeat(self.idf, self.held) * tf * (K1 + 1) / (tf + norm[self.owner])
        self.n = len(units)

    def neighbours(self, unit: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Unused units that share a telling term with ``unit``, best first; ties by position."""
        term = np.unique(unit)
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        at = at[(self.terms[at] == term) & (self.idf[at] > 0)]
        held = self.held[at]
        postings = np.repeat(self.first[at] - np.cumsum(held) + held, held) + np.arange(held.sum())
        total = np.round(np.bincount(self.owner[postings], weights=self.score[postings], minlength=self.n), 9)
        total[used] = 0
        hit = np.flatnonzero(total)
        return hit[np.argsort(-total[hit], kind="stable")]


def pack_shard(units: list[np.ndarray], window: int = WINDOW, corpus: tuple[int, int, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(unit, start, length, sequence, offset) for every piece of a shard's units."""
    index, sizes = Index(units, corpus), np.array([len(u) for u in units])
    left, used = sizes.copy(), np.zeros(len(units), dtype=bool)
    longest, at, total, sequence = np.argsort(-sizes, kind="stable").tolist(), 0, int(sizes.sum()), 0
    while total:
        while used[longest[at]]:
            at += 1
        seed = longest[at]
        room = size = window if total >= window else 1 << (total.bit_length() - 1)
        near = index.neighbours(units[seed], used).tolist() if left[seed] < size else []
        for source in ([seed], near, longest[at:]):
            for i in source:
                if not room:
                    break
                if not used[i]:
                    n = min(int(left[i]), room)
                    yield i, int(sizes[i] - left[i]), n, sequence, size - room
                    left[i] -= n
                    used[i] = not left[i]
                    room -= n
        total -= size
        sequence += 1


def rarity(held: np.ndarray) -> np.ndarray:
    """The place of each term among those that several units hold, rarest first; the others
    come behind them all."""
    order = np.lexsort((np.arange(len(held)), np.where(held > 1, held, np.iinfo(np.int64).max)))
    out = np.empty(len(held), dtype=np.uint32)
    out[order] = np.arange(len(held))
    out[held <= 1] = 0xFFFFFFFF
    return out


def rare_key(unit: np.ndarray, rank: np.ndarray) -> bytes:
    """The places of a unit's rarest terms that other units hold as well, rarest first; where
    there are fewer, all ones follow."""
    left, first = rank[unit], b""
    while len(left) and len(first) < 4 * KEY_TERMS:
        least = left.min()
        first += int(least).to_bytes(4, "big")
        left = left[left > least]
    return first.ljust(4 * KEY_TERMS, b"\xff")


def _encoded(docs: DataFrame, path: str, window: int) -> DataFrame:
    """A row for each document: checksums of the windows that it fills, and the ids of the rest.

    ``first`` numbers the windows' sequences, ``uid`` the rows. At the end of a task comes a row
    without uid: in ``wholes`` the terms of its units, and in ``rest`` how many units hold each.
    """
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("uid long, doc_tokens long, first long, wholes array<long>, rest binary").fields])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid, sequence = tokenizer(path), TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        held, id_type = np.zeros(len(words.ends), dtype=np.int64), None
        place, order = np.zeros(len(words.ends), dtype=np.int32), np.arange(window, dtype=np.int32)
        for batch in batches:
            rows, id_type = [], batch.column("doc_id").type
            for ids in words.encode_all(text or "" for text in batch.column("text").to_pylist()):
                ids = np.append(ids, np.uint32(END_ID))
                whole = len(ids) // window * window
                wholes = [zlib.crc32(ids[s : s + window]) for s in range(0, whole, window)]
                rest, nth = ids[whole:], order[: len(ids) - whole]
                place[rest] = nth
                held[rest[place[rest] == nth]] += 1  # each term once, where it stands last
                rows.append((uid, len(ids), sequence, wholes, rest.astype(words.small).tobytes()))
                uid, sequence = uid + 1, sequence + len(wholes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)
        if id_type is not None:
            at = np.flatnonzero(held)
            last = [None, None, None, at.tolist(), held[at].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *(pa.array([x], k) for x, k in zip(last, kinds, strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def _holders(counted: DataFrame, terms: int) -> np.ndarray:
    """For each term the units of the corpus that hold it, from the tasks' last rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term, raw in zip(batch.column("wholes").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.frombuffer(raw, dtype="<i8"), pa.int64())], names=["term", "df"])

    found = counted.select("wholes", "rest").mapInArrow(spread, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term
    out = np.zeros(terms, dtype=np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def _edges(units: DataFrame, places: Callable, parts: int, n: int) -> list[bytes]:
    """Places that cut the units into about equal ranges, from a sample of bounded size."""
    if parts == 1:
        return []
    few = units.filter(F.pmod(F.xxhash64("uid"), F.lit(max(1, n // (SAMPLED * parts)))) == 0).select("uid", "rest")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch), pa.binary())], names=["place"])

    found = sorted(few.mapInArrow(take, "place binary").toArrow()["place"].to_pylist())
    return [found[i * len(found) // parts] for i in range(1, parts)] if found else []


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    words = tokenizer(path)
    small, terms = words.small, len(words.ends)
    encoded = cut(_encoded(docs, path, window), "encoded")
    piece = StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    names = ["doc_id", *piece.names]
    whole = encoded.filter("uid IS NOT NULL").select("doc_id", "doc_tokens", "first", F.posexplode("wholes").alias("pos", "ids_crc32")).select(
        "doc_id",
        (F.col("pos") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.col("pos")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rows = encoded.filter("uid IS NOT NULL")
    units = rows.filter(F.octet_length("rest") > 0).select("doc_id", "uid", "doc_tokens", "rest")
    n, tokens = units.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rest")), F.lit(0)) / np.dtype(small).itemsize).first()
    parts = max(1, min(MOST_PARTS, -(-int(tokens) // (PART_SHARDS * shard_tokens))))
    held = _holders(encoded.filter("uid IS NULL"), terms)
    spark = docs.sparkSession.sparkContext
    corpus = spark.broadcast((n, max(int(tokens), 1), held, rarity(held)))  # two numbers for each term of the tokenizer

    def places(batch: pa.RecordBatch) -> list[bytes]:
        """Where units stand in the order: by their rarest terms, then by uid."""
        rank = corpus.value[3]
        rows = zip(batch.column("uid").to_pylist(), batch.column("rest").to_pylist(), strict=True)
        return [rare_key(np.frombuffer(raw, dtype=small), rank) + uid.to_bytes(8, "big") for uid, raw in rows]

    edges = spark.broadcast(_edges(units, places, parts, n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places(batch)
            part = [bisect_right(edges.value, x) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(part, pa.int32())], names=[*batch.schema.names, "place", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 62) + (TaskContext.get().partitionId() << 40)
        shards: list[list[tuple]] = [[]]
        size = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal sequence
            parts = [np.frombuffer(raw, dtype=small).astype("<u4") for _, _, raw in rows]
            made, used = [], 0
            for i, start, length, q, offset in pack_shard(parts, window, corpus.value[:3]):
                all_tokens = rows[i][1]
                made.append((i, all_tokens - len(parts[i]) + start, length, zlib.crc32(parts[i][start : start + length].tobytes()), all_tokens, sequence + q, offset))
                used = q + 1
            sequence += used
            doc_id = pa.array([r[0] for r in rows], id_type).take(pa.array([m[0] for m in made], pa.int64()))
            return pa.RecordBatch.from_arrays([doc_id, *(pa.array([m[i] for m in made], pa.int64()) for i in range(1, 7))], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest")), strict=True):
                shards[-1].append(row)
                size += len(row[2]) // np.dtype(small).itemsize
                if size >= shard_tokens:
                    if len(shards) > 1:
                        yield close(shards.pop(0))
                    shards.append([])
                    size = 0
        if len(shards) > 1 and 2 * size < shard_tokens:  # the last shard joins the one before it
            shards[-2:] = [shards[-2] + shards[-1]]
        for rows in shards:
            if rows:
                yield close(rows)

    dealt = units.mapInArrow(deal, StructType([*units.schema.fields, *StructType.fromDDL("place binary, part int").fields]))
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("place")
    packed = dealt.select("doc_id", "doc_tokens", "rest").mapInArrow(pack, StructType([docs.schema["doc_id"], *piece.fields]))
    return whole.unionByName(packed)


def op7_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
