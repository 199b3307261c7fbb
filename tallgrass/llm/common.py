"""Helpers shared by the training-data operators: the shared folder, Arrow text slices, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task turns into numpy arrays at once (a longer text goes alone).
SLICE_BYTES = 1 << 18
#: Bytes of a batch that Spark hands to a Python worker (a longer row goes alone).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one set on the context, or on a single machine (as in
    tests) a temporary one of our own. On a cluster without either this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallgrass-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(df: DataFrame) -> None:
    """Remove the files of a written table that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds batches to Python workers by bytes as well, unless the session says how: 10,000 long texts would be held whole
    by the executor and by each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, f"{BATCH_BYTES}b"))


def partitions_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions for so many bytes, each about each at most: the session's number, or more where that is too few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of a text or binary column at most. Arrow's free memory goes back after each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # or a worker keeps what earlier batches took


def text_slices(texts: Iterator[pa.Array], limit: int = SLICE_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """For each array of texts, the list of its slices as batches of one column named text."""
    for text in texts:
        yield list(slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), limit=limit))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, 2 * SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; a run ends where its text does."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(is_word)]
    first[edge] = is_word[edge]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edge = edge[edge > 0] - 1
    last[edge] = is_word[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial modulo 2**64 from prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: ASCII lower case, as a table over bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
