"""Merkle fingerprints of documents (operator 6), with DataFrame functions only.

The tree of a text: leaves are runs of at most ``LEAF_WORDS`` words that end early at
the end of a sentence, so an edit moves only the leaves of its own sentence; a line's
leaves make a paragraph; paragraphs make sections, closed by an empty line or by a
paragraph whose hash is 0 modulo ``SECTION`` (so that sections resynchronise after an
edit); the sections make the root. Equal texts have equal trees, and two trees need
comparing only where the hashes of a branch differ.

The fingerprint writes the tree out: ``root:section paragraph paragraph|section ...`` in
hexadecimal, where a paragraph is its own hash and, each behind a comma, its leaves.
Likeness is a function of two fingerprints alone, read from the top: equal roots are 1
alike; below them it is 2 * shared leaves / all leaves, over distinct leaves, and trees
that share all leaves but not the root are just below 1 alike. ``changed`` names the
paragraphs of one fingerprint that another lacks.

Defined results: a null text is an empty one; equal roots, two empty texts among them,
are 1 alike; texts without words have no leaves and are 0 alike unless their roots are
equal; without documents there are no rows; a single document is its own next one; rows
with the same doc_id follow each other in the order of their texts; rows without doc_id
come first; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

LEAF_WORDS = 4
SECTION = 8
#: Rows of a range of neighbouring doc_ids, and the most ranges: CELLS * SLICES.
RANGE_ROWS, CELLS, SLICES = 1_000, 1_024, 64
_LEAF = r"(?:[^\s]*[^\s.!?]\s+){0,%d}[^\s]+" % (LEAF_WORDS - 1)


def _hex(h: Column, digits: int = 16) -> Column:
    return F.substring(F.lpad(F.lower(F.hex(h)), 16, "0"), 17 - digits, digits)


def leaves(text: Column) -> Column:
    """array<array<long>>: the hashes of each paragraph's leaves."""
    return F.transform(
        F.split(text, "\n", -1),
        # the exact characters count as well, so that white space is not lost
        lambda p: F.concat(
            F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.xxhash64(x)),
            F.array(F.xxhash64(F.lit(1), p)),
        ),
    )


def fingerprint(text: Column, tree: Column) -> Column:
    """The tree as a string, from the leaves of ``tree``."""
    # "hash,leaf,leaf " for each paragraph, with "|" after one that closes a section
    marked = F.transform(
        tree,
        lambda p: F.concat(
            _hex(F.xxhash64(p), 8),
            F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.concat(F.lit(","), _hex(x, 8))), ""),
            F.when((F.size(p) == 1) | (F.pmod(F.xxhash64(p), F.lit(SECTION)) == 0), F.lit("|")).otherwise(F.lit(" ")),
        ),
    )
    sections = F.transform(F.split(F.array_join(marked, ""), r"\|", -1), lambda s: F.concat(_hex(F.xxhash64(s), 8), F.lit(" "), F.rtrim(s)))
    body = F.array_join(F.filter(sections, lambda s: F.length(s) > 9), "|")
    return F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(F.lit(2), body)), F.lit(":"), body)


def root(printed: Column) -> Column:
    return F.substring(printed, 1, 32)


def leaf_set(printed: Column) -> Column:
    """The distinct leaves that a fingerprint holds."""
    parts = F.split(printed, ",")
    return F.array_distinct(F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.substring(x, 1, 8)))


def paragraphs(printed: Column) -> Column:
    """The hashes of a fingerprint's paragraphs, in order."""
    parts = F.flatten(F.transform(F.split(F.substring(printed, 34, 1 << 30), r"\|"), lambda s: F.slice(F.split(s, " "), 2, 1 << 30)))
    return F.transform(parts, lambda p: F.substring(p, 1, 8))


def changed(a: Column, b: Column) -> Column:
    """Hashes of the paragraphs of fingerprint ``a`` that ``b`` lacks; none for equal roots."""
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(F.array_except(paragraphs(a), paragraphs(b)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    x, y = leaf_set(a), leaf_set(b)
    every = F.size(x) + F.size(y)
    alike = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(every, F.lit(1))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.least(alike, 1 - 1 / (every + 1)))


def with_range(rows: DataFrame, range_rows: int) -> DataFrame:
    """Adds ``key`` (doc_id, nulls lowest) and ``range``, which never falls as the key rises.

    Quantiles of doc_id, at most ``CELLS``, cut cells of about equal counts; a cell of
    many rows is cut evenly into ``SLICES`` at most. Only quantiles reach the driver.
    """
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    cells = max(1, min(CELLS, -(-n // range_rows)))
    slices = max(1, min(SLICES, -(-n // (cells * range_rows))))
    wanted = [i / cells for i in range(1, cells)]
    edges = sorted({int(e) for e in rows.approxQuantile("doc_id", wanted, 0.2 / cells)} - {low}) if wanted else []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    cell = F.size(F.filter(array(edges), lambda e: e <= F.col("key")))
    rows = rows.withColumn("key", key).withColumn("cell", cell)
    lows, highs = F.element_at(array([low, *edges]), F.col("cell") + 1), F.element_at(array([*edges, high + 1]), F.col("cell") + 1)
    within = (F.greatest(F.col("key"), lows).cast("double") - lows) * slices / (highs - lows).cast("double")
    return rows.withColumn("range", F.col("cell") * slices + F.least(F.lit(slices - 1), F.floor(within)).cast("int")).drop("cell")


def next_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, W]:
    """Rows of doc_id, text, tail, with a window over which the next row is the next document.

    One shuffle deals the texts into ranges of doc_id. The first row of a range also goes,
    as a tail, behind the last row of the range before it (the very first behind the very
    last), so that each row finds its successor in its own range.
    """
    rows = with_range(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), range_rows)
    firsts = with_range(docs.select("doc_id"), range_rows).groupBy("range").agg(F.min("key").alias("key"))
    order = W.orderBy("range")  # CELLS * SLICES rows at most
    firsts = firsts.select(
        "key", F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("behind")
    )
    rows = rows.join(F.broadcast(firsts), "key", "left")
    places = F.filter(
        F.array(F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.col("behind").alias("range"), F.lit(1).alias("tail"))),
        lambda x: x["range"].isNotNull(),
    )
    rows = rows.select("doc_id", "key", "text", F.explode(places).alias("at")).select("doc_id", "key", "text", "at.range", "at.tail")
    return rows, W.partitionBy("range").orderBy("tail", "key", "text")


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, ahead = next_documents(docs, range_rows)
    rows = rows.select("doc_id", "key", "text", "range", "tail", fingerprint(F.col("text"), leaves(F.col("text"))).alias("fingerprint"))
    rows = rows.select(
        "doc_id",
        "text",
        "tail",
        "fingerprint",
        F.char_length("text").cast("long").alias("n_chars"),
        F.lead("text").over(ahead).alias("next_text"),
        F.lead("fingerprint").over(ahead).alias("next"),
    ).filter(F.col("tail") == 0)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    )
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"), leaves(F.col("edited"))))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def op6_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
