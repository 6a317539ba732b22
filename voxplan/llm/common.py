"""What the text operators share: reading tables, the shared folder, and vectorised work on Arrow text.

Texts are looked at as one array of UTF-8 bytes for a slice of rows, so tokens, hashes and windows are found by numpy
over the slice and never row by row. A null text counts as empty everywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: from now on the session sends Python at most 1,000 rows and 16 MB at once, if it doesn't send less anyway."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only where that is unset and all run on one machine."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster, steps need one that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="voxplan-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs a read, not a recomputation.

    Nothing reads the write's shuffle files after it, so Spark deletes them at its end rather than when the driver collects garbage.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows of two longs that are sent to every task to leave rows out, at most; beyond it both sides are shuffled.
KNOWN = 1_000_000


def without_rows(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs (doc_id, ...) without the rows whose (key, doc_id) is one of gone (row, doc_id), nulls alike; columns and order stay."""
    row, doc = fresh("row", docs.columns), fresh("doc", docs.columns)
    gone = written(gone.select(F.col("row").alias(row), F.col("doc_id").alias(doc)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.limit(KNOWN + 1).count() <= KNOWN else gone
    return docs.join(gone, (key == gone[row]) & docs["doc_id"].eqNullSafe(gone[doc]), "left_anti")


def fresh(name: str, *taken: list[str]) -> str:
    """name, or name with as many underscores as make it no column of the lists, whatever the case."""
    have = {c.lower() for columns in taken for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) of slices of about CHUNK_BYTES; bytes are uint8, text i is bytes[offsets[i]:offsets[i+1]]."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
            part = pc.cast(pc.fill_null(texts.slice(first, last - first), ""), pa.large_binary())
            _, offsets, data = part.buffers()
            at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(first, last - first), raw, at - at[0]
            first = last


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): words of white-space split texts as byte ranges; words of text i are first[i]:first[i+1].

    inside: which byte values belong to words, by default all but tab to carriage return and space.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mark = np.zeros(n + 1, bool)
    mark[:n] = (~SPACE if inside is None else inside)[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = mark[:-1]
    start = np.flatnonzero(mark & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~mark))
    return start, end, np.searchsorted(start, offsets)


def powers(n: int, which: str = "up") -> np.ndarray:
    if len(_powers[which]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        step = np.full(size, _BASE if which == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = np.multiply.accumulate(step)
    return _powers[which][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """p with range_hash(p, s, e) the hash of bytes s:e, whatever lies around them."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[raw] * powers(len(raw)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, mixed; equal for equal bytes."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), "down")[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_spans(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first): the words that each shingle of `width` words has; fewer words make one shingle of them all, no words none."""
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(made, out=at[1:])
    start = np.arange(at[-1]) - np.repeat(at[:-1], made) + np.repeat(first[:-1], made)
    return start, np.minimum(start + width, np.repeat(first[1:], made)), at


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the shingles of shingle_spans()."""
    start, stop, at = shingle_spans(first, width)
    h = np.zeros(len(start), np.uint64)
    for k in range(width):
        there = start + k < stop
        h[there] = mix(h[there] * np.uint64(31) + hashes[start[there] + k] + np.uint64(k + 1))
    return h, at


def ordered_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], 0 where that is empty."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out
