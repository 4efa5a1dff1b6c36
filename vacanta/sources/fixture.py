"""A Python data source that scans sources side by side, one partition each.

The connector reads NDJSON pages of ``<platform>/<key>/page-*.ndjson`` under its path; a
failing source becomes an error row and leaves the others alone.
"""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "platform string, key string, record string, status string, error string, error_class string, duration_ms long, _seq long"


def classify(error: BaseException) -> str:
    """deadline, canceled, timeout or the type's name."""
    if isinstance(error, TimeoutError):
        return "timeout"
    return {"DeadlineExceeded": "deadline", "CancelledError": "canceled"}.get(type(error).__name__, type(error).__name__)


class PageGuard:
    """Stops a pagination that repeats a page."""

    def __init__(self):
        self.seen: set[tuple] = set()

    def repeated(self, ids: list[str]) -> bool:
        page = tuple(ids)
        if page in self.seen:
            return True
        self.seen.add(page)
        return False


@dataclass
class SourcePartition(InputPartition):
    platform: str
    key: str


class FixtureReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.root, "*", "*")))
        return [SourcePartition(os.path.basename(os.path.dirname(p)), os.path.basename(p)) for p in found if os.path.isdir(p)]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        began, n, guard = time.monotonic(), 0, PageGuard()
        spent = lambda: int((time.monotonic() - began) * 1000)
        try:
            for page in sorted(glob.glob(os.path.join(self.root, partition.platform, partition.key, "page-*.ndjson"))):
                with open(page, encoding="utf-8") as f:
                    rows = [line.strip() for line in f if line.strip()]
                if guard.repeated(rows):
                    break
                for line in rows:
                    json.loads(line)
                    yield partition.platform, partition.key, line, None, None, None, None, n
                    n += 1
            yield partition.platform, partition.key, None, "complete", None, None, spent(), n
        except Exception as e:
            yield partition.platform, partition.key, None, "failed", str(e), classify(e), spent(), n


class FixtureSource(DataSource):
    """spark.read.format("job_boards").load(path)"""

    @classmethod
    def name(cls):
        return "job_boards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FixtureReader(self.options["path"])


#: Sources read at a time where none is named.
WIDTH = 8


def scan(spark: SparkSession, path: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Records, and a run fact for each source; at most ``width`` sources are read at a time."""
    spark.dataSource.register(FixtureSource)
    rows = spark.read.format("job_boards").load(path).coalesce(max(1, width))
    runs = rows.filter("status IS NOT NULL").select("platform", "key", "status", "error", "error_class", "duration_ms", F.col("_seq").alias("postings"))
    return rows.filter("record IS NOT NULL").select("platform", "key", "record", "_seq"), runs
