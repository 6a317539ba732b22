"""How the tokens of two vocabularies meet: tokens that end at the same byte are linked, and links are counted corpus-wide.

Pair counts are kept outside of memory, as sorted runs:

1. A task encodes its documents with both vocabularies and gathers their links as (B id, A id, document) keys. RUN links make a
   run: they are sorted, dealt to RADICES parts by B id, and each part is spilled as two zstd blocks, the pairs with their number
   of links and, for each pair, the documents. Spilled runs lie in the shared folder.
2. A part's blocks of pairs are joined by a k-way heap merge, FANIN runs at once and in levels where there are more. A pair's
   links are one entry for each run however many documents hold it, so a frequent pair is as light as a rare one. Pairs come out
   by B id, the side whose maxima are asked for, so a B id's highest count is known when its last pair has left the merge.
3. Each run's blocks of documents meet the counts of their part, in as many copies as there are groups of runs, and stream each
   document's sums back. A run has a row for each part, and these add up to its documents' figures.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mix, read_table, written

BYTE_BPE = "byte_bpe_50k"
PIECE_BPE = "piece_bpe_32k"
#: Links and documents of a run, parts that it is dealt to, and runs that one merge takes, at most.
RUN = 1 << 21
DOCS = 1 << 16
RADICES = 64
FANIN = 64
#: Bytes of text that are encoded at once, about.
_TEXT = 1 << 19
_SUMMARY = ("doc_id", "n_a", "n_b", "n_groups", "n_links")


@functools.cache
def vocabularies(byte_path: str | None = None, piece_path: str | None = None):
    """(encode A, A's tokens as bytes, encode B, B's tokens as bytes); paths are without .tiktoken, and with .model."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(f"{byte_path or public_tokenizers.path(f'{BYTE_BPE}.tiktoken').removesuffix('.tiktoken')}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for token, at in ranks.items():
        a_bytes[at] = token
    byte_level = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path or public_tokenizers.path(f"{PIECE_BPE}.model"))
    b_bytes = [bytes([int(p[3:5], 16)]) if pieces.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(pieces.IdToPiece, range(pieces.GetPieceSize())))]
    return byte_level.encode_ordinary, a_bytes, functools.partial(pieces.encode, num_threads=1), b_bytes


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as one zstd block, byte plane by byte plane."""
    out = []
    for c in columns:
        width = 4 if not len(c) or int(c.max()) < 1 << 32 else 8
        out.append(struct.pack("<BQ", width, len(c)) + c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(block: bytes) -> list[np.ndarray]:
    """The arrays of packed(), as int64."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        width, n = struct.unpack_from("<BQ", raw, at)
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64))
        at += 9 + n * width
    return out


@functools.cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, their number) of 0..n-1, as rows of characters with one place to spare."""
    texts = [str(i).encode() for i in range(n)]
    wide = max(map(len, texts)) + 1
    return np.frombuffer(b"".join(t.ljust(wide) for t in texts), np.uint8).reshape(n, wide), np.array([len(t) for t in texts])


class Links:
    """Texts' tokens, groups and links: `summary` columns of all texts, and the links as (text, A id, B id)."""

    def __init__(self, texts: list[str | None], byte_path: str | None = None, piece_path: str | None = None):
        encode_a, a_bytes, encode_b, b_bytes = vocabularies(byte_path, piece_path)
        whole = [i for i, t in enumerate(texts) if t]
        a_ids, b_ids, kept = [], [], []
        for i, b in zip(whole, encode_b([texts[i] for i in whole]) if whole else []):
            a, text = encode_a(" " + texts[i]), b" " + texts[i].encode()
            if b"".join(map(a_bytes.__getitem__, a)) == text == b"".join(map(b_bytes.__getitem__, b)):
                a_ids.append(a), b_ids.append(b), kept.append(i)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.array([x for one in ids for x in one], np.int64) for ids in (a_ids, b_ids))
        end_a, end_b = (np.cumsum(sizes[ids]) for ids, sizes in ((a, _sizes(byte_path, piece_path, 0)), (b, _sizes(byte_path, piece_path, 1))))
        top = int(end_a[-1]) + 1 if len(a) else 1
        is_a, is_b = np.zeros(top, bool), np.zeros(top, bool)
        is_a[end_a], is_b[end_b] = True, True
        last_a, last_b = is_b[end_a], is_a[end_b]  # tokens that end a group
        text = np.repeat(np.arange(len(kept)), n_a)[last_a]
        groups = np.bincount(text, minlength=len(kept))
        self.a, self.b, self.text = a[last_a], b[last_b], np.array(kept, np.int64)[text]
        self.summary = [np.zeros(len(texts), np.int64) for _ in range(4)]
        for column, of in zip(self.summary, (n_a, n_b, groups, groups)):
            column[kept] = of
        self.sha256 = [""] * len(texts)
        if len(a):
            self._hash(a, b, last_a, last_b, n_a + n_b, kept, max(len(a_bytes), len(b_bytes)))

    def _hash(self, a, b, last_a, last_b, tokens, kept, ids: int) -> None:
        """Each text's groups as text, A before B; all tokens in that order have their digits and one mark after them."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + np.flatnonzero(last_a)[group_b] + 1
        token, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        token[at_a], token[at_b] = a, b
        mark[at_a], mark[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        digits, many = _decimals(ids)
        size = many[token]
        chars = digits[token]
        chars[np.arange(len(token)), size] = mark
        chars = chars[np.arange(digits.shape[1]) <= size[:, None]]
        stop = np.cumsum(size + 1)[np.cumsum(tokens) - 1]
        for i, s, e in zip(kept, np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist()):
            self.sha256[i] = hashlib.sha256(chars[s : e - 1]).hexdigest()


@functools.cache
def _sizes(byte_path: str | None, piece_path: str | None, side: int) -> np.ndarray:
    return np.array([len(x) for x in vocabularies(byte_path, piece_path)[1 + 2 * side]])


def _bits(byte_path: str | None, piece_path: str | None) -> int:
    """Bits of an A id in a key."""
    return (len(_sizes(byte_path, piece_path, 0)) - 1).bit_length()


def _radix(b: np.ndarray, radices: int) -> np.ndarray:
    return (mix(b.astype(np.uint64)) % np.uint64(radices)).astype(np.int64)


def _spilled_run(keys: list[np.ndarray], docs: int, bits: int, radices: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, pairs, documents) of a run's links: pairs have key and number of links, then each pair's documents and times."""
    step = max(1, docs - 1).bit_length()
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    record, times = keys[first], np.diff(first, append=len(keys))
    pair, doc = record >> step, record & ((1 << step) - 1)
    radix = _radix(pair >> bits, radices)
    order = np.argsort(radix, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(radix[order])) + 1):
        own, d, t = pair[part], doc[part], times[part]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        gap = np.diff(d, prepend=0)
        gap[new] = d[new]
        yield int(radix[part[0]]), packed(np.diff(own[new], prepend=0), np.add.reduceat(t, new)), packed(np.diff(new, append=len(own)), gap, t)


def spill(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, run: int = RUN, radices: int = RADICES) -> DataFrame:
    """(run, radix, pairs, docs): the runs of docs (doc_id, text), written; in the row of radix -1 `docs` are the documents' own figures."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, number = _bits(byte_path, piece_path), TaskContext.get().partitionId() << 32
        keys, made, links, n_docs = [], [], 0, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(made)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            rows = [(-1, b"", sink.getvalue().to_pybytes())]
            if links:
                step = max(1, n_docs - 1).bit_length()
                rows += _spilled_run([(k << step) | d for k, d in keys], n_docs, bits, radices)
            radix, pairs, blocks = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array(radix, pa.int32()), pa.array(pairs, pa.binary()), pa.array(blocks, pa.binary())], ["run", "radix", "pairs", "docs"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TEXT, "right")))
                one = Links(texts[at:stop], byte_path, piece_path)
                keys.append(((one.b << bits) | one.a, one.text + n_docs))
                made.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *map(pa.array, one.summary), pa.array(one.sha256, pa.string())], [*_SUMMARY, "groups_sha256"]))
                links, n_docs, at = links + len(one.a), n_docs + stop - at, stop
                if links >= run or n_docs >= DOCS:
                    yield from flushed()
                    keys, made, links, n_docs, number = [], [], 0, 0, number + 1
        if made:
            yield from flushed()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "run long, radix int, pairs binary, docs binary"), "links")


def merged(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, links) of blocks of sorted pairs, each pair once and in order: a heap holds the next pair of every block."""

    def items(block: bytes) -> Iterator[tuple[int, int]]:
        gaps, counts = unpacked(block)
        return zip(np.cumsum(gaps).tolist(), counts.tolist())

    pairs, counts = [], []
    for pair, count in heapq.merge(*map(items, blocks)):
        if pairs and pairs[-1] == pair:
            counts[-1] += count
        else:
            pairs.append(pair), counts.append(count)
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def count_pairs(spilled: DataFrame, byte_path: str | None = None, piece_path: str | None = None, fanin: int = FANIN) -> DataFrame:
    """(radix, counts): for each part of spill() a block of its pairs, their corpus-wide links, and whether these are their B id's most."""
    runs = spilled.where("radix >= 0").select("run", "radix", "pairs")
    many = spilled.where("radix = -1").count()

    def merge(table: pa.Table, last: bool) -> pa.Table:
        pair, count = merged([x.as_buffer().to_pybytes() for x in table.column("pairs")])
        columns = [np.diff(pair, prepend=0), count]
        if last:
            b = pair >> _bits(byte_path, piece_path)
            first = np.flatnonzero(np.diff(b, prepend=-1))
            columns.append(count == np.repeat(np.maximum.reduceat(count, first), np.diff(first, append=len(b))))
        out = {"run": table.column("run")[:1], "radix": table.column("radix")[:1], "pairs": pa.array([packed(*columns)], pa.binary())}
        return pa.table({k: out[k] for k in ("radix", "pairs")} if last else out)

    while many > fanin:
        many = -(-many // fanin)
        group = F.pmod(F.xxhash64("run"), F.lit(many)).alias("run")
        runs = written(runs.select(group, "radix", "pairs").groupBy("radix", "run").applyInArrow(lambda t: merge(t, False), "run long, radix int, pairs binary"), "merged")
    return written(runs.groupBy("radix").applyInArrow(lambda t: merge(t, True), "radix int, pairs binary").withColumnRenamed("pairs", "counts"), "counts")


def pair_counts(counts: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(a, b, links, best) of count_pairs(): a row for each pair of ids that is linked anywhere."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(byte_path, piece_path)
        for batch in batches:
            for block in batch.column(0):
                gaps, links, best = unpacked(block.as_buffer().to_pybytes())
                pair = np.cumsum(gaps)
                yield pa.RecordBatch.from_arrays([pa.array(pair & ((1 << bits) - 1)), pa.array(pair >> bits), pa.array(links), pa.array(best == 1)], ["a", "b", "links", "best"])

    return counts.select("counts").mapInArrow(work, "a long, b long, links long, best boolean")


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, run: int = RUN, radices: int = RADICES, fanin: int = FANIN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for each row of docs (doc_id, text).

    A text that is null or empty, or that either vocabulary doesn't give back byte for byte (B writes U+2581 as a space), has
    zeros and an empty groups_sha256, and no links. Repeated rows and ids, and null ids, are documents of their own; no rows
    give no rows; other columns play no part. Every token has a byte at least, so two tokens meet in an end at most, and links
    are as many as groups.
    """
    spilled = spill(docs, byte_path, piece_path, run, radices)
    counts = count_pairs(spilled, byte_path, piece_path, fanin)
    copies = -(-spilled.where("radix = -1").count() // fanin) or 1
    salted = counts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    parts = spilled.where("radix >= 0").withColumn("copy", F.pmod(F.xxhash64("run"), F.lit(copies)).cast("int")).join(salted, ["radix", "copy"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs, blocks, counted in zip(*(batch.column(i) for i in (1, 2, 3))):
                own = np.cumsum(unpacked(pairs.as_buffer().to_pybytes())[0])
                per, gap, times = unpacked(blocks.as_buffer().to_pybytes())
                gaps, links, best = unpacked(counted.as_buffer().to_pybytes())
                at = np.repeat(np.searchsorted(np.cumsum(gaps), own), per)
                run_sum = np.cumsum(gap)  # gaps start anew with each pair
                start = np.cumsum(per) - per
                doc = run_sum - np.repeat(run_sum[start] - gap[start], per)
                ids, place = np.unique(doc, return_inverse=True)
                total = np.zeros((2, len(ids)), np.int64)
                np.add.at(total[0], place, times * best[at])
                np.add.at(total[1], place, times * links[at])
                out.append(packed(np.diff(ids, prepend=0), *total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(out), pa.int32()), pa.array(out, pa.binary())], ["run", "radix", "docs"])

    def assemble(table: pa.Table) -> pa.Table:
        made, total = None, []
        for radix, block in zip(table.column("radix").to_pylist(), table.column("docs")):
            if radix < 0:
                made = pa.ipc.open_stream(block.as_buffer()).read_all()
            else:
                total.append(unpacked(block.as_buffer().to_pybytes()))
        best, count = (np.zeros(len(made), np.int64) for _ in range(2))
        for gaps, b, c in total:
            at = np.cumsum(gaps)
            best[at] += b
            count[at] += c
        return made.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(count))

    back = parts.select("run", "pairs", "docs", "counts").mapInArrow(sums, "run long, radix int, docs binary")
    both = back.unionByName(spilled.where("radix = -1").select("run", "radix", "docs"))
    return both.groupBy("run").applyInArrow(assemble, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents' tokens in the two public vocabularies, and how common these are; as align() says."""
    return align(read_table(spark, sf_dir, "documents"))
