"""What the operators share: reading tables, cutting lineage, hashing words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Rows of a text table that go to Python at once; bounds the memory of a worker.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def at_end(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver ends, as results may be read until then."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    Later stages start from the files, so a lost executor costs one re-read and no
    expression is computed twice. ``drop_cut`` deletes the files when nothing reads them
    any more; what a result still needs goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` wrote and nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small, so that one long text more does no harm."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_values(df: DataFrame, column: str, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """``df`` without ``column``, and with the new columns of ``ddl``, without a shuffle.

    ``make()`` is called once in each task; what it returns gives a tuple for each value
    of ``column``. The other columns pass through as Arrow arrays, nulls and all.
    """
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != column]
    new = StructType.fromDDL(ddl)
    kinds = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = make()
        for batch in batches:
            rows = [value(x) for x in batch.column(column).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + made, names=others + new.names)

    schema = StructType([df.schema[c] for c in others] + new.fields)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """The rows for whose value of ``column`` the function that ``make()`` returns is true."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for batch in batches:
            yield batch.filter(pa.array([bool(good(x)) for x in batch.column(column).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


# ---------------------------------------------------------------- words as hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which every bit depends on all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, dtype=np.uint64)
_UNDO = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _UNDO
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        up = np.full(size, _ODD)
        down = np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS, _UNDO = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[:n], _UNDO[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hashes mod 2^64: any slice's hash follows from two of them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=out[1:])
    return out


def slice_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    undo = _powers(len(running))[1]
    return mix((running[end] - running[start]) * undo[start] + (end - start).astype(np.uint64))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    if not data:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    inside = np.concatenate(([False], ~_SPACE[np.frombuffer(data, dtype=np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order; texts of any length, a block at a time."""
    start, end = words(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    raw, parts, first = np.frombuffer(data, dtype=np.uint8), [], 0
    while first < len(start):
        last = max(int(np.searchsorted(end, start[first] + BLOCK, "right")), first + 1)
        at = start[first]
        running = prefix_hashes(raw[at : end[last - 1]])
        parts.append(slice_hashes(running, start[first:last] - at, end[first:last] - at))
        first = last
    return np.concatenate(parts)


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k words in a row, sorted; all words as one if they are fewer."""
    if not len(word):
        return word
    n = min(k, len(word))
    acc = np.full(len(word) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        acc = mix(acc * _ODD + word[i : len(word) - n + 1 + i])
    return np.unique(acc)


def utf8(texts: Iterable) -> Iterator[bytes]:
    """UTF-8 bytes of texts; null counts as empty."""
    for t in texts:
        yield b"" if t is None else (t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"))
