"""From documents to packed sequences, in stages that each take all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). Labels come from
``sf_dir``. Stages 1 to 4 return the columns of documents, the last one a row for each piece.
Rows without doc_id pass the filters on their texts alone; ``n_chars`` follows the text.
Null and empty texts count as empty; other columns pass through whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacanta.llm.common import cut, keep_rows, table
from vacanta.llm.line_dedup import dedup_lines
from vacanta.llm.near_dedup import near_duplicates
from vacanta.llm.packing import pack_documents
from vacanta.llm.quality_classifier import PER_CLASS as QUALITY_SAMPLE
from vacanta.llm.quality_classifier import THRESHOLD as QUALITY
from vacanta.llm.quality_classifier import train as train_quality
from vacanta.llm.toxicity import PER_CLASS as TOXIC_SAMPLE
from vacanta.llm.toxicity import THRESHOLD as TOXIC
from vacanta.llm.toxicity import train as train_toxicity
from vacanta.llm.training import labelled_texts


def toxicity(spark, docs, sf_dir):
    """Drops documents whose toxicity score reaches the threshold."""
    model = train_toxicity(*labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", TOXIC_SAMPLE))
    return keep_rows(docs, "text", lambda: lambda t: model.score(t) < TOXIC)


def quality(spark, docs, sf_dir):
    """Drops documents whose quality score stays below the threshold."""
    model = train_quality(*labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_SAMPLE))
    return keep_rows(docs, "text", lambda: lambda t: model.score(t) >= QUALITY)


def lines(spark, docs, sf_dir):
    """Drops lines that many documents share, but for their last document."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_copies(spark, docs, sf_dir):
    """Keeps the first document of each component of near duplicates, and of rows that share
    its doc_id one. Rows without doc_id stay."""
    gone = cut(near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).filter("__again IS NOT NULL AND __n > 1").select("__again")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns)))
    first = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi").withColumn("__one", one).filter("__one = 1").drop("__one")
    return kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(first)


def packing(spark, docs, sf_dir):
    """Sequences of tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("packing", packing)]
#: Trained models, components and packing have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
