"""The corpus fold as a stream: each batch of (postings, runs) is one run.

Rows are never closed by a watermark: only a qualifying run of their own source may.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import Policy, fold, open_corpus, publish


def fold_batch(directory: str, batch: DataFrame, number: int, policy: Policy = Policy()) -> None:
    """Folds every run of a batch, in clock order, into the corpus at ``directory``. A batch
    that was folded before is skipped, so a restart repeats nothing. ``batch`` has run_at,
    a struct ``posting`` with _seq or null, and a struct ``run`` or null."""
    spark = batch.sparkSession
    clocks = [r[0] for r in batch.select("run_at").distinct().orderBy("run_at").collect()]
    for at in clocks:
        manifest, rows, sources = open_corpus(spark, directory)
        if manifest is not None and datetime.fromisoformat(manifest["run_at"]) >= at.replace(microsecond=0):
            continue
        part = batch.filter(F.col("run_at") == F.lit(at))
        postings = part.filter("posting IS NOT NULL").select("posting.*")
        runs = part.filter("run IS NOT NULL").select("run.*")
        done = fold(rows.drop("outcome", "state", "platform", "source_key"), sources, runs, postings, at, policy=policy)
        publish(directory, (manifest["generation"] + 1) if manifest else 1, done, at.replace(microsecond=0), (manifest or {}).get("runs"))


def start(stream: DataFrame, directory: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, n: fold_batch(directory, df, n, policy)).option("checkpointLocation", checkpoint).start()
