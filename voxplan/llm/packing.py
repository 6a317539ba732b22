"""Concatenate and cut: documents' token ids, end to end, cut into windows of one length.

The first pass tokenizes each partition as a stream and writes every document's ids with its start within the partition.
The partitions' totals, one number each, are summed up on the driver to give the partitions' global starts. The second
pass then knows every id's global place, so windows, offsets and the pieces of documents that cross a boundary follow row
by row, without a shuffle. Only the very last sequence can be short; it is the only one with padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, written

LENGTH = 2048
END = 1
TOKENIZER = "byte_bpe_50k"
_loaded: dict = {}


def tokenizer(path: str | None = None):
    """texts -> lists of ids, for the byte-level vocabulary at `path` without its extension (by default the public one).

    The ids are those of the .json file in the tokenizers library; they are found through the .tiktoken file of the same
    vocabulary, which is faster. Texts that hold the vocabulary's special token go through the former.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(f"{TOKENIZER}.json").removesuffix(".json")
    if path not in _loaded:
        with open(f"{path}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(f"{path}.json")
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def encode(texts: list[str]) -> list[list[int]]:
            return [slow.encode(x, add_special_tokens=False).ids if any(s in x for s in special) else fast.encode_ordinary(x) for x in texts]

        _loaded[path] = encode
    return _loaded[path]


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) of docs (doc_id, text): ids as little-endian bytes, 2 for each id below 2^16;
    start: the document's first id within its partition `part`. A null or empty text has the end id alone. Written once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                ids = [np.array([*x, end], "<u4") for x in encode([x or "" for x in rows.column(1).to_pylist()])]
                n = np.array([len(x) for x in ids])
                start = at + np.cumsum(n) - n
                at = int(start[-1] + n[-1])
                packed = [x.astype("<u2").tobytes() if int(x.max()) < 1 << 16 else b"\xff" + x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part)), pa.array(start), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "part", "start", "n_tokens", "ids"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, part long, start long, n_tokens long, ids binary"), "tokens")


def unpack(ids: bytes) -> np.ndarray:
    """The ids of a row of tokenized(), as 32-bit; the wide form is known by its odd length."""
    return np.frombuffer(ids, "<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


def pack(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of tokenized() rows."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect()  # a number for each partition
    base, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        base[part], at = at, at + n
    base = tokens.sparkSession.sparkContext.broadcast(base)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                part, start, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                first = np.array([base.value[p] for p in part.tolist()], np.int64) + start
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = np.maximum(first[row], (first[row] // length + turn) * length)
                stop = np.minimum(first[row] + n[row], (first[row] // length + turn + 1) * length)
                ids = [unpack(x.as_buffer().to_pybytes()) for x in rows.column(4)]
                cut = [ids[r][s:e].tobytes() for r, s, e in zip(row.tolist(), (begin - first[row]).tolist(), (stop - first[row]).tolist())]
                out = [rows.column(0).take(pa.array(row)), begin - first[row], stop - begin, np.array([zlib.crc32(x) for x in cut], np.int64), n[row], begin // length, begin % length]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out] + [pa.array(cut, pa.binary())] * with_ids, names)

    return tokens.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of LENGTH ids."""
    return pack(tokenized(read_table(spark, sf_dir, "documents")))
