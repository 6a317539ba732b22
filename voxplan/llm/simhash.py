"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: the 64 bits are cut into blocks of odd length, and a block's code words are
all zeros and all ones, so every fingerprint has one nearest anchor, its home (the majority of each block). A fingerprint
within `distance` bits of x can lie near x's home only; it is therefore replicated to every anchor that is the home of some
point within `distance` bits of it. Those are the anchors within covering radius plus threshold that can matter: blocks are
flipped to their minority at a price of the missing bits, and all sets of blocks that cost at most `distance` are taken.
Per anchor, the fingerprints at home there are compared with those replicated to it.

Exact copies share a fingerprint and are one row from the start. An anchor's two lists are dealt to a grid of cells of at
most CELL x CELL expected comparisons, so a hot anchor is many bounded cells, and a cell returns a spanning forest of its
links rather than all of them. Longer blocks give fewer replicas and more comparisons: by default the length is chosen from
the number of fingerprints, results do not depend on it. With the shortest block comparisons still grow with the square of
the number of different fingerprints, by 2^-14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, discarded, fresh, mix, prefix_hash, range_hash, read_table, shingle_spans, shingles, text_slices, without_rows, words, written
from .graph import components, forest
from .jaccard import SIGN, bucket_roots, reach, shared, signs, supported

DISTANCE = 4
WIDTH = 4
#: Lengths of blocks to choose from, and the cost of a replica in comparisons.
BLOCKS = (5, 7, 9, 11)
REPLICA = 100
#: Jaccard likeness of near duplicates where no number of bits is asked for.
SIMILARITY = 0.8
CELL = 4096
#: Bits of a word's hash by which words are counted together, to tell the frequent ones.
COUNTED = 14
_FLUSH = 1 << 15


def simhash(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit fingerprints of texts: bit set where over half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    start, end, first = words(raw, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(start):
        return out
    size = end - start + 1
    to = np.cumsum(size)
    joined = np.append(LOWER[raw], np.uint8(32))[np.arange(to[-1]) + np.repeat(start - (to - size), size)]
    joined[to - 1] = 32
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], made) + np.repeat(first[:-1], made)
    last = np.minimum(begin + width, np.repeat(first[1:], made)) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(text[s:e], 42) for s, e in zip((to - size)[begin].tolist(), (to - 1)[last].tolist())], np.uint64)
    full = np.flatnonzero(made)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > made[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, name: str = "fp") -> DataFrame:
    """docs with a long column `name`, the last: the fingerprint of `text` (null: empty, so 0); all other columns stay.

    If docs has a column of that name, in any case, the new one gets underscores at its end until it's another.
    """
    name = fresh(name, docs.columns)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(simhash(raw, offsets, width).view(np.int64))], [*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _blocks(length: int) -> list[int]:
    """Odd block lengths that add up to 64."""
    full, rest = divmod(64, length)
    return [length] * full + ([rest] if rest % 2 else [rest - 1, 1] if rest else [])


def anchors(fps: np.ndarray, distance: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each, index, anchor): fps[index] is replicated to anchor."""
    blocks = _blocks(length)
    sets = [s for n in range(distance + 1) for s in combinations(range(len(blocks)), n)]
    member = np.zeros((len(blocks), len(sets)), np.int16)
    for k, s in enumerate(sets):
        member[list(s), k] = 1
    mask = np.array([sum(1 << b for b in s) for s in sets], np.int64)
    home, price, shift = np.zeros(len(fps), np.int64), np.empty((len(fps), len(blocks)), np.int16), 0
    for b, n in enumerate(blocks):
        ones = np.bitwise_count((fps >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int16)
        major = ones > n // 2
        home |= major.astype(np.int64) << b
        price[:, b] = np.where(major, ones - n // 2, n // 2 + 1 - ones)
        shift += n
    index, which = np.nonzero(price @ member <= distance)
    return home, index, home[index] ^ mask[which]


def block_for(n: int, distance: int = DISTANCE) -> int:
    """The length of blocks that costs least for n fingerprints, taken as random ones."""
    some = np.random.default_rng(1).integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2)
    cost = lambda b: len(anchors(some, distance, b)[1]) * (REPLICA + n / (1 << len(_blocks(b))))
    return min(BLOCKS, key=cost)


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what links between a and b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = [], []
    for k in range(0, len(b), 256):
        j, i = np.nonzero(np.bitwise_count(a[None, :] ^ b[k : k + 256, None]) <= distance)
        u.append(at[: len(a)][i])
        v.append(at[len(a) :][j + k])
    u, v = np.concatenate(u), np.concatenate(v)
    root = forest(u, v, len(nodes))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, block: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` exactly as all links of `distance` bits or fewer do; block: the blocks' length, by default block_for()."""
    block = block or block_for(fps.count(), distance)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= _FLUSH:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << len(_blocks(block))), np.int64)
        for part in arrays(batches):
            home, _, to = anchors(part, distance, block)
            total[0] += np.bincount(home, minlength=total.shape[1])
            total[1] += np.bincount(to, minlength=total.shape[1])
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["anchor", "homes", "visits"])

    # As many rows as the code has words at most, whatever the input.
    sizes = fps.select("fp").mapInArrow(count, "anchor long, homes long, visits long").groupBy("anchor").agg(F.sum("homes"), F.sum("visits")).collect()
    n_words = 1 << len(_blocks(block))
    rows, cols, base = np.ones(n_words, np.int64), np.ones(n_words, np.int64), np.zeros(n_words, np.int64)
    for anchor, homes, visits in sizes:
        rows[anchor], cols[anchor] = max(1, -(-homes // CELL)), max(1, -(-visits // CELL))
    live = np.zeros(n_words, bool)
    live[[r[0] for r in sizes if r[1]]] = True
    base[1:] = np.cumsum(rows * cols)[:-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays(batches):
            home, index, to = anchors(part, distance, block)
            salt = mix(part)
            index, to = index[live[to]], to[live[to]]
            row = (salt % rows[home].astype(np.uint64)).astype(np.int64)
            col = ((salt[index] >> np.uint64(20)) % cols[to].astype(np.uint64)).astype(np.int64)
            for kind, fp, first, step, times in ((0, part, base[home] + row * cols[home], 1, cols[home]), (1, part[index], base[to] + col, cols[to], rows[to])):
                which = np.repeat(np.arange(len(fp)), times)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                cell = first[which] + turn * (step if kind == 0 else step[which])
                order = np.argsort(cell, kind="stable")
                cells, at = np.unique(cell[order], return_index=True)
                data = fp[which][order].tobytes()
                ends = [*at[1:].tolist(), len(order)]
                blobs = [data[8 * s : 8 * e] for s, e in zip(at.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), kind, np.int8)), pa.array(blobs, pa.binary())], ["cell", "kind", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if have[0] and have[1]:
                u, v = _forest(np.concatenate(have[0]), np.concatenate(have[1]), distance)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            for cell, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if cell != now:
                    yield from done()
                    now, have = cell, ([], [])
                have[kind].append(np.frombuffer(blob.as_buffer(), np.uint64))
        yield from done()

    dealt = fps.select("fp").mapInArrow(deal, "cell long, kind byte, fps binary").repartition("cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(compare, "u long, v long")


def groups(fps: DataFrame, distance: int = DISTANCE, block: int | None = None) -> DataFrame:
    """(fp, component_id) for rows (doc_id, fp): the least doc_id that is reachable by links, itself included; one row for each distinct fp."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(classes, distance, block)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document. A document without words has fingerprint 0 and is linked like any other; a null doc_id is no candidate for component_id."""
    docs = written(fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"), "docs")
    return docs.join(groups(docs), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_hashes(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(low, offsets)
    return range_hash(prefix_hash(low), start, end), first


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTED)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """How rare the words of each cell of 2^COUNTED are in all docs (text): 4 log2 of one in how many words, 255 at most."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTED, np.int64)
        for _, raw, offsets in text_slices(batches):
            total += np.bincount(_cells(_word_hashes(LOWER[raw], offsets)[0]), minlength=1 << COUNTED)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "times"])

    # As many rows as there are cells at most, whatever the input.
    times = np.ones(1 << COUNTED, np.int64)
    for cell, n in docs.select("text").mapInArrow(run, "cell long, times long").groupBy("cell").agg(F.sum("times")).collect():
        times[cell] = n
    return np.minimum(255, np.round(4 * np.log2(times.sum() / times))).astype(np.uint8)


def _shingled(docs: DataFrame, what: str, width: int, similarity: float = SIMILARITY, rare: np.ndarray | None = None) -> DataFrame:
    """Of docs (row, doc_id, text) with their distinct shingles:

    "sets": (row, shingles); "docs": (row, doc_id, set_key, n, fp, sign); "prefixes": (bucket, id, n, at), a row for each element of
    the extended prefixes, id the set_key. There shingles of rare words come first, by `rare` from rarity(), equally rare ones in order of hash:
    any order leaves out no pair, and in this one a line of a great many texts, or a common phrase, is in few prefixes.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            hashes, first = _word_hashes(LOWER[raw], offsets)
            h, at = shingles(hashes, first, width)
            sets, where = zip(*(np.unique(h[s:e], return_index=True) for s, e in zip(at[:-1].tolist(), at[1:].tolist())))
            row = rows.column(rows.schema.get_field_index("row"))
            size = np.array([len(x) for x in sets], np.int64)
            if what == "sets":
                yield pa.RecordBatch.from_arrays([row, _lists(sets, size)], ["row", "shingles"])
                continue
            keys = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), signed=True) for x in sets], np.int64)
            if what == "prefixes":
                some = reach(size, similarity)
                start, stop, _ = shingle_spans(first, width)
                level = np.concatenate([[0], np.cumsum(rare[_cells(hashes)].astype(np.int64))])
                level = level[start] - level[stop]
                order = (np.argsort(level[s:][i], kind="stable")[:k] for s, i, k in zip(at.tolist(), where, some.tolist()))
                flat = np.concatenate([x[o] for x, o in zip(sets, order)]).view(np.int64)
                places = np.arange(len(flat)) - np.repeat(np.cumsum(some) - some, some)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(keys, some)), pa.array(np.repeat(size, some).astype(np.int32)), pa.array(places.astype(np.int32))], ["bucket", "id", "n", "at"])
                continue
            sign = _lists(list(signs(np.concatenate(sets), size)), np.full(len(sets), SIGN // 64))
            made = [pa.array(keys), pa.array(size.astype(np.int32)), pa.array(simhash(raw, offsets, width).view(np.int64)), sign]
            yield pa.RecordBatch.from_arrays([row, rows.column(rows.schema.get_field_index("doc_id")), *made], ["row", "doc_id", "set_key", "n", "fp", "sign"])

    kinds = {"sets": "row long, shingles array<long>", "docs": "row long, doc_id long, set_key long, n int, fp long, sign array<long>", "prefixes": "bucket long, id long, n int, at int"}
    return docs.mapInArrow(run, kinds[what])


def _lists(values: list[np.ndarray], sizes: np.ndarray) -> pa.ListArray:
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def near_groups(docs: DataFrame, width: int = 5, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, component_id) for docs (row, doc_id, text): the least doc_id reachable by links of that Jaccard likeness of the texts' shingle sets.

    Equal sets are one from the start (texts without words have the empty set). Candidates are fingerprints within
    `distance` bits, from the anchors, which connect most at little cost, and then sets that share an element of their
    prefixes, which leaves out no pair: jaccard.py tells how. Every link is verified by the sets, so none is wrong and,
    but for two different shingles of one 64-bit hash, none is lost.
    """
    marked = written(_shingled(docs, "docs", width), "docs")
    classes = written(marked.where("n > 0").groupBy(F.col("set_key").alias("id")).agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sign").alias("sign")), "classes")
    # Shingled again rather than kept: the prefixes of all are as large as the texts.
    common = written(shared(_shingled(docs, "prefixes", width, similarity, rarity(docs))), "shared")
    members = written(supported(common, similarity), "members")
    discarded(common)
    fps = classes.groupBy("fp").agg(F.min("id").alias("of"))
    u, v = fps.select(F.col("fp").alias("u"), F.col("of").alias("a")), fps.select(F.col("fp").alias("v"), F.col("of").alias("b"))
    near = links(written(fps, "fps"), distance).join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = written(near.union(classes.join(fps, "fp").where("id <> of").select(F.col("id").alias("u"), F.col("of").alias("v"))), "near")

    def sets(ids: DataFrame, few: bool) -> DataFrame:
        # Read and shingled again for each call, but for these texts only: cheaper than to keep the sets of all.
        rows = classes.select("id", "row").join(F.broadcast(ids) if few else ids, "id")
        texts = docs.join(F.broadcast(rows) if few else rows, "row").select(F.col("id").alias("row"), "doc_id", "text")
        return _shingled(texts, "sets", width).select(F.col("row").alias("id"), "shingles").dropDuplicates(["id"])

    rooted = classes.select("id").join(bucket_roots(members, sets, similarity, near, signed=classes.select("id", "n", "sign")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    least = marked.groupBy(F.col("set_key").alias("id")).agg(F.min("doc_id").alias("least")).join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(component, "root").select(F.col("id").alias("set_key"), "component_id")
    return marked.select("row", "doc_id", "set_key").join(of, "set_key").select("row", "doc_id", "component_id")


def keep_first_of_groups(docs: DataFrame, width: int = 5, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near_groups(): that with the least doc_id. Rows that share that doc_id are one document and all stay; columns stay as they are.

    Rows with a null doc_id go if their group has any other member, else they stay.
    """
    key = F.xxhash64("doc_id", "text")
    found = near_groups(docs.select(key.alias("row"), "doc_id", "text"), width, distance, similarity)
    return without_rows(docs, key, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
