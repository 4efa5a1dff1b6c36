"""Shards of near-equal bytes: a minimax contiguous partition (operator 10).

Groups of equal texts are atomic and ordered by the hash of their text. A binary search
finds the smallest capacity for which a greedy pass over the groups needs no more than
the wanted shards; the shards are cut there.

The driver never holds all groups. Neighbours are first summed into at most
``2 ** ATOM_BITS`` atoms. Between the capacity that these allow and the least that could
do, each cut can lie in a few atoms only; those are split by more bits of the hash, and
the search is repeated, until every atom in which a cut may lie is a single group. The
capacity and the cuts are then those over all groups.

Defined results: a null text is an empty one (size 16, crc32 0); an empty table gives
no rows; rows that repeat are each placed, all in one shard since their text is the
same; texts of any length count with all their bytes; extra columns are ignored; more
shards than groups leave the last shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

ATOM_BITS = 16
#: Atoms that one further search may add, about.
MOST_ATOMS = 1 << 17
#: A size counts this much besides the bytes of the text.
ROW_BYTES = 16
#: Rows of one atom that are numbered in one task; a larger atom is dealt over several.
#: With more rows than ATOM_ROWS << ATOM_BITS the figure rises, to bound the parts.
ATOM_ROWS = 1_000


def greedy_cuts(totals: list[int], capacity: int, most: int) -> list[int] | None:
    """Ends of shards filled up to ``capacity`` in order, or None if ``most`` are too few.

    ``totals`` are running sums of the atoms' sizes; each cut is a bisection.
    """
    cuts: list[int] = []
    at = 0
    while at < len(totals):
        before = totals[at - 1] if at else 0
        end = bisect_right(totals, before + capacity)
        if end == at or len(cuts) == most:
            return None
        cuts.append(end)
        at = end
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where each shard ends."""
    if not sizes:
        return 0, []
    totals = list(accumulate(sizes))
    low, high = max(max(sizes), -(-totals[-1] // shards)), totals[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(totals, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(totals, low, shards) or []


def uncertain(atoms: list[tuple[int, int, int]], shards: int, least: int, capacity: int) -> list[int]:
    """Atoms (first hash, last hash, bytes) of several groups in which a cut may lie.

    Over the groups a cut lies no earlier than the greedy cut over atoms of the ``least``
    capacity, and no later than ``capacity`` behind the cut before it.
    """
    big = [i for i, (a, b, size) in enumerate(atoms) if a != b and size > least]
    if big:
        return big  # the greedy pass can't go past them: these first
    totals, at, out = list(accumulate(size for _, _, size in atoms)), 0, set()
    for k in range(1, shards):
        at = bisect_right(totals, (totals[at - 1] if at else 0) + least)
        last = min(bisect_right(totals, k * capacity), len(atoms) - 1)
        out.update(i for i in range(at, last + 1) if atoms[i][0] != atoms[i][1])
    return sorted(out)


def finer_atoms(keys: DataFrame, atoms: list[tuple[int, int, int]], bits: int, finer: int) -> list[tuple[int, int, int]]:
    """Atoms of ``bits`` bits, split by ``finer`` bits."""
    wanted = keys.sparkSession.createDataFrame([(first >> (64 - bits),) for first, _, _ in atoms], "atom long")
    parts = (
        keys.select("h", "size", F.shiftright("h", 64 - bits).alias("atom"))
        .join(F.broadcast(wanted), "atom", "left_semi")  # no more rows than atoms on the driver
        .groupBy(F.shiftright("h", 64 - finer).alias("part"))
        .agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("bytes"))
    )
    return [tuple(r) for r in parts.select("first", "last", "bytes").collect()]


def exact_cuts(keys: DataFrame, found: list[tuple[int, int, int]], shards: int, bits: int = ATOM_BITS) -> list[int]:
    """The last hash of each shard. ``keys`` has a size and a hash ``h`` for each row."""
    level = dict.fromkeys((first for first, _, _ in found), bits)
    while True:
        capacity, ends = minimax_cuts([size for _, _, size in found], shards)
        least = max(-(-sum(size for _, _, size in found) // shards), max((size for a, b, size in found if a == b), default=0))
        split = uncertain(found, shards, least, capacity) if capacity > least else []
        if not split:
            return [found[end - 1][1] for end in ends]
        bits = min(level[found[i][0]] for i in split)  # the coarsest first
        split = [i for i in split if level[found[i][0]] == bits]
        finer = min(64, bits + max(1, (MOST_ATOMS // len(split)).bit_length() - 1))
        parts, gone = finer_atoms(keys, [found[i] for i in split], bits, finer), set(split)
        level |= dict.fromkeys((first for first, _, _ in parts), finer)
        found = sorted([x for i, x in enumerate(found) if i not in gone] + parts)


def shard_documents(docs: DataFrame, shards: int = 40, atom_rows: int = ATOM_ROWS, atom_bits: int = ATOM_BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    ).withColumn("atom", F.shiftright("h", 64 - atom_bits))
    atoms = cut(keys.groupBy("atom").agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-atoms")
    found = atoms.select("first", "last", "bytes", "n").collect()  # 2 ** atom_bits rows at most
    atom_rows = max(atom_rows, sum(r["n"] for r in found) >> ATOM_BITS)
    last = exact_cuts(keys, sorted((r["first"], r["last"], r["bytes"]) for r in found), shards, atom_bits)
    shard = F.lit(0)
    for end in last[:-1]:
        shard = shard + (F.col("h") > end).cast("int")

    # An atom that holds very many rows (copies of one text) is numbered in several parts.
    hot = F.broadcast(atoms.filter(F.col("n") > atom_rows).select("atom", F.ceil(F.col("n") / atom_rows).cast("int").alias("parts")))
    dealt = keys.withColumn("shard", shard).join(hot, "atom", "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)))
    counts = dealt.groupBy("shard", "atom", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("atom", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("atom", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("shard", "atom", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("at", F.row_number().over(own))
        .join(F.broadcast(offsets), ["shard", "atom", "part"])  # a row for each atom, and atom_rows rows for each further part
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at") - 1).alias("slot"))
    )


def op10_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
