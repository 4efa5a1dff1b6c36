"""Lines that many documents share (operator 3), with DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z lower-cased.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold
lose all their lines, but for those in the largest doc_id that holds the key.

Each long line's key is hashed and exploded with its position; documents are counted by
distinct doc_id; a text that loses lines is put together again from the positions that
stay, in time linear in its lines.

Defined results: a null or empty text is one empty line and stays empty; rows that share
a doc_id are one document for the count, and where it is the largest all of them keep
their lines; rows without doc_id are no documents for the count, but lose lines that
others made common; texts of any length are read whole; an empty table gives no rows;
other columns pass through untouched, except that columns named ``n_lines`` and
``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Tasks that a key's lines are dealt over when they meet the common keys.
SALTS = 16


def _key(line: Column) -> Column:
    """128 bits of a line's key.

    A-Z are lower-cased on the bytes read as Latin-1: there lower() also moves the lead
    bytes C0-DE to E0-FE, but as the number of bytes that follow a lead byte stays, keys
    that differ still do.
    """
    folded = F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    return F.struct(F.xxhash64(folded).alias("a"), F.xxhash64(F.lit(7), folded).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(text: Column, min_chars: int) -> Column:
    """For each line its key's hash, or null where the line is too short."""
    trimmed = lambda x: F.btrim(x, F.lit(WHITE))
    return F.transform(_lines(text), lambda x: F.when(F.char_length(trimmed(x)) >= min_chars, _key(trimmed(x))))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``text`` reassembled, ``n_lines`` and ``n_dropped``."""
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rows of one doc_id may differ in their texts: positions are those of an id and a text.
    of = [F.col("doc_id").alias("id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(7), text).alias("two")]
    held = docs.select(*of, F.posexplode(_hashed(F.col("text"), min_chars)).alias("pos", "k")).filter(F.col("k").isNotNull())
    held = cut(held.select("id", "one", "two", "pos", "k.a", "k.b"), "line-keys")
    common = held.select("a", "b", "id").distinct().groupBy("a", "b").agg(F.count("id").alias("n"), F.max("id").alias("owner")).filter(F.col("n") >= min_docs)
    # A key that a third of the documents hold meets its owner in SALTS tasks.
    owners = common.select("a", "b", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id", "one", "pos"), F.lit(SALTS)).cast("int")
    lost = (
        held.withColumn("salt", salt)
        .join(owners, ["a", "b", "salt"])
        .filter(~F.col("id").eqNullSafe(F.col("owner")))
        .groupBy("id", "one", "two")
        .agg(F.collect_set("pos").alias("lost"))  # no more than the lines of one text
    )
    lines = docs.select(F.struct(*others).alias("row"), *of, _lines(F.col("text")).alias("lines"))
    same = [lines[c].eqNullSafe(lost[c]) for c in ("id", "one", "two")]
    joined = lines.join(lost, same[0] & same[1] & same[2], "left").select("row", "lines", "lost")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.col("lines")[i]))
    made = joined.select(
        "row",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return made.select("row.*", "text", "n_lines", "n_dropped")


def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.pos, y.line, c.k IS NOT NULL AND y.doc_id IS DISTINCT FROM c.owner AS gone
  FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
