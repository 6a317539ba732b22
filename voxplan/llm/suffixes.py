"""Removal of repeated passages by a merge sort of suffixes that keeps common prefixes.

A passage is a string of so many bytes; a byte goes if some passage that covers it also starts anywhere else. Each passage
has one anchor, the least hashed k-mer among its first SPREAD positions, so equal passages have their anchors at the same
offset and only the suffixes at anchors need sorting: a passage with offset o is its anchor's left context of o bytes and
the first bytes of its suffix. The same sorted suffixes tell the repeats of several lengths (LENGTHS).

1. Suffixes whose beginning (what every passage of theirs has in common) occurs once have no twin; counts by hash leave
   them out. Hashes only leave out and deal; what is repeated is decided by bytes.
2. Every task sorts its suffixes by beginning and bytes, makes one item of those with equal bytes on both sides, front-codes
   the run (common prefix with the item before, then the rest) and sends each range of beginnings to one merge.
3. A loser tree merges a range's runs as a stream. It keeps, for each loser, the length of its common prefix with the
   winner that beat it, so a comparison starts where the known prefix ends. What leaves it comes with its common prefix
   with the one before, the LCP array of the range. Items of equal bytes are repeated as they stand; for others that share
   the beginning, the LCPs of suffixes and left contexts tell for each offset which passages are equal.
4. The merge returns item numbers and offsets; the run's list of occurrences turns these into places in texts, so a
   frequent suffix is one item for each run, however often it occurs.
5. A beginning with more than GROUP different contexts is one long group. Its offsets are then cut into blocks of
   BLOCK (or of one, past GROUP * GROUP contexts): each block is a suffix of its own that starts at the block's least offset
   and shares a longer beginning, so that the group falls apart into many that are merged in the same way elsewhere.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, mix, prefix_hash, range_hash, read_table, text_slices, written

#: Bytes of a passage that is removed, and of one that is told as shared; the second is what 51 words have nearly always.
LENGTHS = (400, 240)
SPREAD = 128
KMER = 16
GROUP = 256
BLOCK = 16
#: A shared passage is told if it has more words than that.
WORDS = 50
#: Suffixes that a task sorts at once, and that a merge takes, about.
_RUN = 1 << 15
_BUCKET = 20_000
#: Items whose offsets are compared at once, about.
_BATCH = 2048
_WHOLE, _LONG, _SHORT = 0, 1, 2


def anchored(raw: np.ndarray, offsets: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, ...]:
    """(prefix hash, text, anchor, first, last): passages that start at first..last of a text share the anchor; all within raw."""
    hashed = prefix_hash(raw)
    many = np.maximum(np.diff(offsets) - length + 1, 0)
    if not many.sum():
        none = np.zeros(0, np.int64)
        return hashed, none, none, none, none
    kmer = min(KMER, length - spread + 1)
    at = np.arange(len(raw) - kmer + 1)
    least = (range_hash(hashed, at, at + kmer) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= spread:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if spread > width:
        least = np.minimum(least[: width - spread], least[spread - width :])
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[:-1], many)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(start[new[1:] - 1], start[-1])
    return hashed, np.repeat(np.arange(len(many)), many)[new], anchor[new], start[new], last


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, whose first `known` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n:
        step = min(n, known + 64)
        differ = int.from_bytes(a[known:step]) ^ int.from_bytes(b[known:step])
        if differ:
            return step - (differ.bit_length() + 7) // 8
        known = step
    return n


class LoserTree:
    """Merges sorted runs of (key, common prefix with the run's previous key, payload) and yields the same for the whole."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, tuple]]]):
        self.runs = runs
        self.head = [next(r, None) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head += [None] * (self.size - len(runs))
        self.known = [0] * self.size  # common prefix of each head with the key that left last
        self.loser = [0] * self.size
        self.winner = self._build(1) if self.size > 1 else 0

    def _play(self, a: int, b: int) -> int:
        """The winner of two heads; the loser's known prefix becomes that with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return b if x is None else a
        if self.known[a] != self.known[b]:
            return a if self.known[a] > self.known[b] else b  # the longer prefix with what left last is the lesser key
        n = common_prefix(x[0], y[0], self.known[a])
        if x[0][n : n + 1] <= y[0][n : n + 1]:
            self.known[b] = n
            return a
        self.known[a] = n
        return b

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner = self._play(a, b)
        self.loser[node] = b if winner == a else a
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        while self.head[self.winner] is not None:
            run = self.winner
            key, _, payload = self.head[run]
            yield key, self.known[run], payload
            self.head[run] = following = next(self.runs[run], None)
            self.known[run] = following[1] if following else 0
            node, best = (run + self.size) >> 1, run
            while node:
                winner = self._play(best, self.loser[node])
                if winner != best:
                    self.loser[node], best = best, winner
                node >>= 1
            self.winner = best


def packed(data: bytes) -> bytes:
    """data as a zstd block: runs are shuffled, and Spark's own codec there makes larger ones."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


def encode_run(items: list[tuple[bytes, bytes, int, int, int]], run: int, base: int) -> bytes:
    """Front-coded run of sorted (key, left, least offset, block, times); the items are base, base + 1, ... of the run."""
    shared, before = np.zeros(len(items), np.uint16), b""
    for i, item in enumerate(items):
        shared[i] = common_prefix(before, item[0])
        before = item[0]
    rest = [k[0][s:] for k, s in zip(items, shared.tolist())]
    table = [shared, np.array([len(x) for x in rest], np.uint16), np.array([len(x[1]) for x in items], np.uint16), *(np.array([min(x[c], 0xFFFF) for x in items], np.uint16) for c in (2, 3, 4))]
    return packed(struct.pack("<qqI", run, base, len(items)) + b"".join(x.tobytes() for x in table) + b"".join(rest) + b"".join(x[1] for x in items))


def decode_run(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, common prefix with the key before, (left, least offset, block, times, run, item)) of encode_run()."""
    blob = unpacked(blob)
    run, base, n = struct.unpack_from("<qqI", blob)
    at, table = 20, []
    for _ in range(6):
        table.append(np.frombuffer(blob, np.uint16, n, at).tolist())
        at += 2 * n
    left, key = at + sum(table[1]), b""
    for i, (shared, size, width, least, block, times) in enumerate(zip(*table)):
        key = key[:shared] + blob[at : at + size]
        yield key, shared, (blob[left : left + width], least, block, times, run, base + i)
        at, left = at + size, left + width


def repeated_offsets(items: list[tuple[int, bytes, int]], length: int) -> np.ndarray:
    """For each of the items (common prefix with the suffix before, left context, least offset), which are in order of
    their suffixes, and each offset from 0: whether its passage at that offset equals that of another item."""
    g, widest = len(items), max(len(x[1]) for x in items) + 1
    offset = np.arange(widest)
    prefix = np.array([x[0] for x in items])
    right = np.cumsum(prefix[:, None] < length - offset, axis=0)
    lefts = [x[1][::-1] for x in items]
    order = sorted(range(g), key=lefts.__getitem__)
    shared = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:])])
    left = np.empty((g, widest), np.int64)
    left[order] = np.cumsum(shared[:, None] < offset, axis=0)
    least, most = (np.array(x)[:, None] for x in ([x[2] for x in items], [len(x[1]) for x in items]))
    fits = (offset >= least) & (offset <= most)
    both = np.where(fits, right * (g + 1) + left, -1 - np.arange(g)[:, None])
    by = np.argsort(both, axis=0, kind="stable")
    ranked = np.take_along_axis(both, by, 0)
    same = np.zeros((g + 1, widest), bool)
    same[1:g] = ranked[1:] == ranked[:-1]
    out = np.empty((g, widest), bool)
    np.put_along_axis(out, by, same[:-1] | same[1:], 0)
    return out & fits


class Merge:
    """Merges front-coded runs and collects (run, item, kind, least offset, most) of what is repeated."""

    def __init__(self, lengths: tuple[int, int]):
        self.lengths = lengths
        self.out: list[tuple[int, int, int, int, int]] = []
        self.made: list[np.ndarray] = []
        self.batch: list[tuple] = []

    def merge(self, blobs: list[bytes]) -> None:
        group: list[list] = []  # [prefix, left, least, times, run, item]
        same: dict = {}  # the group's items of the present key
        size = 0
        for key, prefix, (left, least, block, times, run, item) in LoserTree([decode_run(x) for x in blobs]):
            if prefix < 8 + self.lengths[1] - block + 1:
                self.close(group)
                group, same = [], {}
            elif prefix < len(key) or size != len(key):
                same = {}
            size = len(key)
            twin = same.get((left, least))
            if twin is not None:
                if twin[3] == 1:
                    twin[3] = 2
                    self.out.append((*twin[4:], _WHOLE, 0, 0))
                self.out.append((run, item, _WHOLE, 0, 0))
                continue
            if times > 1:
                self.out.append((run, item, _WHOLE, 0, 0))
            same[left, least] = own = [prefix - 8 if group else 0, left, least, times, run, item]
            group.append(own)
            if block == 1 and len(group) >= _BATCH:
                # Single passages need their neighbours only: the last two go on, the first of them as a neighbour.
                last = group[-1]
                self.close([*group[:-1], [*last[:3], 2, *last[4:]]])
                group = [[0, *group[-2][1:3], 2, *group[-2][4:]], last]
        self.close(group)
        self.judge()

    def close(self, group: list[list]) -> None:
        if len(group) > 1 and any(x[3] == 1 for x in group):
            self.batch += group
            if len(self.batch) >= _BATCH:
                self.judge()

    def judge(self) -> None:
        if self.batch:
            items = [(x[0], x[1], x[2]) for x in self.batch]
            once = np.array([x[3] == 1 for x in self.batch])
            who = np.array([x[4:] for x in self.batch], np.int64)
            for kind, length in zip((_LONG, _SHORT), self.lengths):
                flags = np.zeros((len(items), max(len(x[1]) for x in items) + 3), np.int8)
                flags[:, 1:-1] = repeated_offsets(items, length) & once[:, None]
                edge = np.diff(flags, axis=1)
                of, low = np.nonzero(edge == 1)
                self.made.append(np.column_stack([who[of], np.full(len(of), kind), low, np.nonzero(edge == -1)[1] - 1]))
            self.batch = []

    def results(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) + sum(map(len, self.made)) > least:
            table = np.concatenate([np.array(self.out, np.int64).reshape(-1, 5), *self.made])
            self.out, self.made = [], []
            yield pa.RecordBatch.from_arrays([pa.array(table[:, c]) for c in range(5)], ["run", "item", "kind", "low", "high"])


def joined_ranges(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges low..high (inclusive) of equal keys made one where they touch."""
    if not len(key):
        return key, low, high
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    shift = key << 40
    reach = np.maximum.accumulate(high + shift)
    new = np.flatnonzero(np.append(True, (low + shift)[1:] > reach[:-1] + 1))
    last = np.append(new[1:] - 1, len(key) - 1)
    return key[new], low[new], reach[last] - shift[last]


def repeats(docs: DataFrame, lengths: tuple[int, int] = LENGTHS, spread: int = SPREAD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc, row, kind, lo, hi), and the written runs that these rows are read from, to be discarded after them: passages that start at bytes lo..hi of a text of docs (doc, row, text) occur elsewhere too.

    kind: of the first of the lengths (1), of the second, which is not longer (2), or of both (0: as far as the text has
    such passages). doc and row: longs, together another for different rows' texts.
    """
    spark = docs.sparkSession
    long, short = lengths
    common = short - spread + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            hashed, text, anchor, first, last = anchored(raw, offsets, short, spread)
            doc, row = (rows.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 1))
            place = (anchor - offsets[text]) << 16 | (anchor - first) << 8 | (anchor - last)
            begin = range_hash(hashed, anchor, anchor + common).view(np.int64)
            context = range_hash(hashed, first, np.minimum(last + long, offsets[text + 1])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (begin, context, doc, row, place)], ["begin", "context", "doc", "row", "at"])

    found = written(docs.select("doc", "row", "text").mapInArrow(find, "begin long, context long, doc long, row long, at long"), "suffixes")
    contexts = found.groupBy("begin", "context").agg(F.count("*").alias("times"))
    shared = contexts.groupBy("begin").agg(F.count("*").alias("size"), F.sum("times").alias("n")).where("n > 1")
    block = F.when(F.col("size") <= group, spread).when(F.col("size") <= group * group, min(BLOCK, spread)).otherwise(1)
    shared = written(shared.select("begin", block.alias("block"), "n"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // _BUCKET))
    # A step of its own: neither the suffixes nor their shuffles are on disk any more when the texts are shuffled.
    sent = written(found.drop("context").join(shared.drop("n"), "begin").groupBy("doc", "row").agg(F.collect_set(F.struct("at", "block")).alias("xs")), "suffixes")
    discarded(found)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[bytes, bytes, int, int, int]] = []
        members: list[np.ndarray] = []
        run = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal run
            items.sort()
            entries, of = [], np.empty(len(items), np.int64)
            before = None
            for key, left, least, width, k in items:
                if (key, left, least, width) == before:
                    entries[-1][4] += 1
                else:
                    before = (key, left, least, width)
                    entries.append([*before, 1])
                of[k] = len(entries) - 1
            cut = [int.from_bytes(x[0][:8]) * buckets >> 64 for x in entries]
            made, at = [], 0
            while at < len(entries):
                end = at + 1
                while end < len(entries) and cut[end] == cut[at]:
                    end += 1
                made.append((cut[at], run, 0, encode_run(entries[at:end], run, at)))
                at = end
            if made:
                table = np.column_stack([of, np.concatenate(members)])
                made.append((-1, run, 1, packed(table[np.argsort(of, kind="stable")].T.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int8(), pa.binary()))], ["bucket", "run", "kind", "data"])
            items.clear()
            members.clear()
            run += 1

        for rows, raw, offsets in text_slices(batches):
            listed = rows.column(3)
            flat, many = listed.flatten(), np.diff(listed.offsets.to_numpy())
            at, width = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            text = np.repeat(np.arange(len(many)), many)
            most, least = at >> 8 & 255, at & 255
            # Suffixes of blocks of offsets start at the block's least offset; blocks as wide as all offsets are the anchor's own suffix.
            n = most // width - least // width + 1
            which = np.repeat(np.arange(len(at)), n)
            width, text = width[which], text[which]
            begins = (least[which] // width + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * width
            anchor = offsets[text] + (at[which] >> 16) - begins
            low, high = np.maximum(least[which] - begins, 0), np.minimum(most[which] - begins, width - 1)
            stop = np.minimum(anchor + long - low, offsets[text + 1])
            keys = mix(range_hash(prefix_hash(raw), anchor, anchor + short - width + 1) + (width << 16 | begins).astype(np.uint64))
            doc, row = (rows.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 1))
            table = np.column_stack([doc, row, anchor - offsets[text], high, low])
            data = raw.tobytes()
            for s in range(0, len(table), _RUN):
                e = min(len(table), s + _RUN)
                k = len(items)
                for i, (h, a, z, m, f, w) in enumerate(zip(*(x[s:e].tolist() for x in (keys, anchor, stop, high, low, width)))):
                    items.append((h.to_bytes(8) + data[a:z], data[a - m : a], f, w, k + i))
                members.append(table[s:e])
                if len(items) >= _RUN:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, merger = None, [], Merge(lengths)
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    merger.merge(have)
                    yield from merger.results(_RUN)
                    now, have = bucket, []
                have.append(blob.as_py())
        merger.merge(have)
        yield from merger.results(0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, listed in zip(batch.column(0), batch.column(1)):
                table = np.frombuffer(unpacked(blob.as_py()), np.int64).reshape(6, -1).T
                item, kind, low, high = (listed.values.field(i).to_numpy().astype(np.int64) for i in range(4))
                order = np.argsort(item, kind="stable")
                item, kind, low, high = (x[order] for x in (item, kind, low, high))
                first, last = np.searchsorted(item, table[:, 0]), np.searchsorted(item, table[:, 0], "right")
                n = last - first
                who = np.repeat(np.arange(len(table)), n)
                of = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                whole, own = kind[of] == _WHOLE, table[who]
                lo, hi = own[:, 3] - np.where(whole, own[:, 4], high[of]), own[:, 3] - np.where(whole, own[:, 5], low[of])
                ids, text = np.unique(own[:, 1:3], axis=0, return_inverse=True)
                key, lo, hi = joined_ranges(text.ravel() << 2 | kind[of], lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[key >> 2, 0], ids[key >> 2, 1], key & 3, lo, hi)], ["doc", "row", "kind", "lo", "hi"])

    made = written(docs.select("doc", "row", "text").join(sent, ["doc", "row"]).mapInArrow(runs, "bucket long, run long, kind byte, data binary"), "runs")
    discarded(sent)
    merged = made.where("kind = 0").select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "run long, item long, kind long, low long, high long")
    merged = merged.groupBy("run").agg(F.collect_list(F.struct("item", "kind", "low", "high")).alias("xs"))
    return made.where("kind = 1").select("run", "data").join(merged, "run").select("data", "xs").mapInArrow(places, "doc long, row long, kind long, lo long, hi long"), made


def without_repeats(docs: DataFrame, lengths: tuple[int, int] = LENGTHS, spread: int = SPREAD, group: int = GROUP) -> DataFrame:
    """(doc_id, kept, n_bytes, removed, shared): kept are the bytes that no repeated passage of the first length covers,
    removed the maximal removed runs as (start, end) bytes; shared are the maximal runs, as (start, end, words), that
    repeated passages of the second length cover.

    A null or empty text, or one that is shorter than a passage, keeps all it has. Rows that repeat doc_id and text are
    documents of their own, and so repeat each other's passages. No rows give none; other columns are left out.
    """
    long, short = lengths
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"doc": F.coalesce("doc_id", F.lit(0)).cast("long"), "row": F.xxhash64("doc_id", "text")})
    spans, runs = repeats(keyed.where(F.octet_length("text") >= short), lengths, spread, group)
    spans = written(spans.groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("spans")), "spans")
    discarded(runs)

    def covered(lo: np.ndarray, hi: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
        hi = np.minimum(hi, size - length)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        _, start, last = joined_ranges(np.zeros(len(lo), np.int64), lo, hi + length - 1)
        return list(zip(start.tolist(), (last + 1).tolist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                out: tuple[list, ...] = ([], [], [], [])
                for text, spans in zip(rows.column(1), rows.column(2)):
                    data = text.as_buffer().to_pybytes()
                    removed, told, kept, at = [], [], [], 0
                    if spans.is_valid:
                        kind, lo, hi = (spans.values.field(i).to_numpy() for i in range(3))
                        removed = covered(lo[kind != _SHORT], hi[kind != _SHORT], long, len(data))
                        told = [{"start": s, "end": e, "words": len(data[s:e].split())} for s, e in covered(lo[kind != _LONG], hi[kind != _LONG], short, len(data))]
                    for s, e in removed:
                        kept.append(data[at:s])
                        at = e
                    out[0].append(b"".join([*kept, data[at:]]))
                    out[1].append(len(data))
                    out[2].append([{"start": s, "end": e} for s, e in removed])
                    out[3].append(told)
                span = [("start", pa.int64()), ("end", pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct(span))), pa.array(out[3], pa.list_(pa.struct([*span, ("words", pa.int64())])))],
                    ["doc_id", "kept", "n_bytes", "removed", "shared"],
                )

    joined = keyed.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, removed array<struct<start:long,end:long>>, shared array<struct<start:long,end:long,words:long>>")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages, as counts and a digest; n_shared counts the repeated passages of over WORDS words, also those of fewer than 400 bytes."""
    out = without_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    told = F.size(F.filter("shared", lambda x: x["words"] > WORDS)).cast("long")
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), told.alias("n_shared"))


def removed_ranges(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The same by trying every passage; for small fixtures."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                runs[-1:] = [(runs[-1][0], i + length)] if runs and runs[-1][1] >= i else [*runs[-1:], (i, i + length)]
        out.append(runs)
    return out


def digest(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of texts, by removed_ranges."""
    out = []
    for t, runs in zip(texts, removed_ranges(texts, length)):
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + t[at:s], e
        out.append((len(t), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept + t[at:]).hexdigest()))
    return out
