"""MinHash fingerprints over word shingles, near-duplicate pairs by signature bands, and fingerprints of edited texts.

A signature holds, for each of PERMUTATIONS universal hash functions, 16 bits of the least hash of the text's distinct
shingles of five lower-cased words (white-space split). Texts without words have the signature of all ones. Equal texts
have equal signatures, and the share of equal places estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, fresh, prefix_hash, range_hash, read_table, shingles, text_slices, words, written
from .jaccard import bucket_roots, of_table, shared

PERMUTATIONS = 128
WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle hashes, first): those of text i are first[i]:first[i+1], repeats included."""
    low = LOWER[raw]
    start, end, first = words(low, offsets)
    h, at = shingles(range_hash(prefix_hash(low), start, end), first, width)
    return h >> np.uint64(32), at


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 signatures, one row for each text: h -> (a h + b) mod 2^64, the top bits of the least."""
    out = np.full((len(first) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    for i in np.flatnonzero(np.diff(first)).tolist():
        own = hashes[first[i] : first[i + 1]]
        least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(own), 512):
            np.minimum(least, (own[k : k + 512, None] * _A + _B).min(axis=0), out=least)
        out[i] = (least >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprints(docs: DataFrame, name: str = "signature") -> DataFrame:
    """docs with a binary column `name`, the last: the signature of `text` (null: empty), big-endian; all other columns stay.

    If docs has a column of that name, in any case, the new one gets underscores at its end until it's another.
    """
    name = fresh(name, docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            made = signatures(*shingle_sets(raw, offsets)).astype(">u2")
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.tobytes() for x in made], pa.binary())], [*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, component_id): class_id is the least doc_id of the same shingle set, component_id the least
    doc_id reachable by verified links; texts without words are no one's near duplicate.

    Texts of one shingle set are one class from the start. Classes whose signatures agree in a band are candidates, and
    a candidate is verified by the exact Jaccard likeness of the two sets. In a band's bucket all classes meet that are
    not yet connected, so no connection within it is lost; jaccard.py tells how.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            h, at = shingle_sets(raw, offsets)
            sets = [np.unique(h[at[i] : at[i + 1]]).astype(np.int64) for i in range(len(at) - 1)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            made = signatures(h, at).astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array([x.tobytes() for x in made], pa.binary())], ["doc_id", "set_key", "shingles", "signature"]
            )

    made = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, shingles array<long>, signature binary"), "signatures")
    least = made.where(F.size("shingles") > 0).groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    classes = written(least.join(made.withColumnRenamed("doc_id", "class_id"), ["set_key", "class_id"]).dropDuplicates(["set_key"]).select("class_id", "shingles", "signature"), "classes")
    size = 2 * PERMUTATIONS // bands
    rows = classes.select(F.col("class_id").alias("id"), F.size("shingles").alias("n"), F.lit(0).alias("at"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.col("signature").substr(b * size + 1, F.lit(size))))).alias("bucket"))
    linked = bucket_roots(written(shared(rows), "band"), of_table(classes.select(F.col("class_id").alias("id"), "shingles")), similarity)
    lowest = linked.groupBy("root").agg(F.least(F.min("id"), F.col("root")).alias("component_id"))
    roots = linked.join(lowest, "root").select(F.col("id").alias("class_id"), "component_id")
    member = made.join(least, "set_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return member.join(roots, "class_id", "left").select("doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def with_next(docs: DataFrame, rows_each: int = 2000, most: int = 10_000) -> DataFrame:
    """Rows (doc_id, text) with the next document's, in descending doc_id and from the last on to the first again.

    Documents are cut into ranges of about rows_each, or `most` longer ranges, by quantiles of doc_id. The first document of a range is also sent
    to the range before, so one shuffle brings every document together with its next, and ranges are read as streams.
    What reaches the driver and every task is one doc_id for each range, so `most` bounds it. Rows of equal doc_id follow each other by text; a null
    doc_id comes last.
    """
    spark, count = docs.sparkSession, docs.count()
    n = max(1, min(most, -(-count // rows_each)))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)}, reverse=True) if n > 1 else []
    cut = spark.sparkContext.broadcast(np.array(cuts[::-1], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = len(cut.value) - np.searchsorted(cut.value, ids.fill_null(-(1 << 63)).to_numpy(), "left")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = len(cut.value) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "range"])

    lines = docs.select("doc_id", "text")
    placed = lines.mapInArrow(place, "doc_id long, text string, range long")
    firsts = {r["range"]: r["doc_id"] for r in docs.select("doc_id").mapInArrow(place, "doc_id long, range long").groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()}
    order = sorted(firsts)
    gives = {firsts[k]: order[i - 1] for i, k in enumerate(order)}
    sends = spark.createDataFrame([(k, v) for k, v in gives.items() if k is not None] or [(None, None)], "doc_id long, target long")
    sends = F.broadcast(sends)  # one row for each range
    null_to = gives.get(None)
    target = F.coalesce("target", F.when(F.col("doc_id").isNull(), F.lit(null_to)))
    head = placed.join(sends, "doc_id", "left")
    last = order[-1] if order else 0
    both = head.select(
        "doc_id", "text",
        F.explode(F.when(target.isNull(), F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("sent")))).otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("sent")), F.struct(target.alias("at"), F.lit(1).alias("sent"))))).alias("x"),
    ).select("doc_id", "text", F.col("x.at").alias("at"), F.col("x.sent").alias("sent"))
    dealt = both.repartition(max(1, min(n, 1000000)), "at").sortWithinPartitions("at", "sent", F.desc_nulls_last("doc_id"), "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held is not None and held[2] == row[2]:
                    out.append((held[0], held[1], row[0], row[1]))
                held = None if row[3] else row
            if out:
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "text", "next_id", "next_text"])

    del last
    return dealt.mapInArrow(follow, "doc_id long, text string, next_id long, next_text string")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last floor(n/3) code points give way to the first of the next document (fewer if that is shorter).

    One row for each row. A null or empty text has no code points to give, and the fingerprint of no shingles; before one, a document just loses
    its last third. A single document is its own next. Of rows of one doc_id the lesser text comes first; null ids come last. An empty table gives none.
    """
    pairs = with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                own, nxt = [x or "" for x in part.column(1).to_pylist()], [x or "" for x in part.column(3).to_pylist()]
                edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(own, nxt)]
                made = []
                for texts in (own, edited, nxt):
                    as_batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
                    made.append(np.concatenate([signatures(*shingle_sets(raw, at)) for _, raw, at in text_slices([as_batch])]) if texts is not nxt else None)
                # The next document's own fingerprint is the next row's, but for the last row here.
                after = np.concatenate([made[0][1:], np.zeros((1, PERMUTATIONS), np.uint16)])
                ids, next_ids = part.column(0).to_pylist(), part.column(2).to_pylist()
                odd = [i for i in range(len(own)) if i + 1 == len(own) or ids[i + 1] != next_ids[i] or own[i + 1] != nxt[i]]
                if odd:
                    as_batch = pa.RecordBatch.from_arrays([pa.array([nxt[i] for i in odd], pa.large_string())], ["text"])
                    after[odd] = np.concatenate([signatures(*shingle_sets(raw, at)) for _, raw, at in text_slices([as_batch])])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        *(pa.array([x.tobytes().hex() for x in y.astype(">u2")]) for y in made[:2]),
                        *(pa.array((made[0] == y).mean(axis=1)) for y in (made[1], after)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return pairs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
