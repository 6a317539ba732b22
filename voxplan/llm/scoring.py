"""Language-model scores: a token model as base, and context-tree weighting over bytes.

Context-tree weighting: a byte is eight binary decisions, each made in a node of a binary tree of the bits so far. Every
node keeps, for the contexts of the last 0 to DEPTH whole bytes, Krichevsky-Trofimov estimates, and mixes them over all
depths with the weights of the context tree (1/2 for a leaf at each depth, by the probability that each side gave the
training data). Texts are scored with the model as trained; a text ends with a byte that UTF-8 doesn't have, so
probabilities of all texts sum to one. Before a text stand bytes of 0.

The model is a table of grams (DEPTH context bytes and the byte after them) that grows with the corpus. Grams of texts
that are held out are in it with a count of 0, which changes no probability, so every gram that is scored has its row.
Below depth SPLIT the tree falls into parts that need nothing of each other (a part has 256^(DEPTH - SPLIT) contexts at
most), so grams are dealt by the latest SPLIT bytes and each task mixes its parts; what these leave for the depths above
is one row for a node of two context bytes, under 2^24 rows whatever the corpus, and is mixed on the driver.

The most frequent grams, 2^GRAMS at most, and tokens that make up over 2^-20 of the corpus, 2^20 at most, go to every
task; all others meet their values in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, ordered_sums, prefix_hash, range_hash, read_table, text_slices, words, written

DEPTH = 5
SPLIT = 3
GRAMS = 21
END_BYTE = 0xFF
END_TOKEN = -1
_COMMON = 20
_TOKEN, _BYTE = 0, 1
#: Grams that a task mixes, on average; grams of texts that one vectorised step looks at.
_PART, _PIECE = 1 << 17, 1 << 19


def gram_pieces(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, text) for every byte of the texts and their end bytes, in pieces, as one text may be very long.

    The code is the context (latest byte highest) times 256 plus the byte.
    """
    ends = offsets[1:] + np.arange(1, len(offsets))
    out = np.zeros(len(raw) + (len(offsets) - 1) * (depth + 1), np.uint8)
    for start, stop, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ((offsets[:-1] + np.arange(len(ends)) * (depth + 1)) + depth).tolist()):
        out[at : at + stop - start] = raw[start:stop]
        out[at + stop - start] = END_BYTE
    for k in range(0, len(raw) + len(ends), _PIECE):
        gram = np.arange(k, min(k + _PIECE, len(raw) + len(ends)))
        text = np.searchsorted(ends, gram, "right")
        here = gram + depth * (text + 1)
        code = out[here].astype(np.int64)
        for d in range(depth):
            here -= 1
            code |= out[here].astype(np.int64) << (8 * (depth - d))
        yield code, text


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the lower-cased white-space tokens, without the ends."""
    low = LOWER[raw]
    start, end, first = words(low, offsets)
    return range_hash(prefix_hash(low), start, end).view(np.int64), first


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out); a null doc_id is not held out."""
    return docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))


class _Tally:
    """Counts by key in bounded memory: rows (kind, code, n) go out when there are too many keys, a key possibly more than once."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts = kind, []

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, n))
        if sum(len(p[0]) for p in self.parts) > 1 << 21:
            self._merge()
            if len(self.parts[0][0]) > 1 << 20:
                yield from self.out()

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        self.parts = [(keys, np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(keys)).astype(np.int64))]

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, n = self.parts.pop()
            for k in range(0, len(keys), 1 << 17):
                c = keys[k : k + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), self.kind, np.int8)), pa.array(c), pa.array(n[k : k + (1 << 17)])], ["kind", "code", "n"])


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, code, n): how often the texts that are not held out have each token (by hash) and each gram; grams of held out texts count 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grams = _Tally(_TOKEN), _Tally(_BYTE)
        codes: list[np.ndarray] = []

        def add_grams() -> Iterator[pa.RecordBatch]:
            if codes:
                marked = np.concatenate(codes)
                codes.clear()
                marked.sort()
                at = _runs(marked)
                n = np.diff(np.append(at, len(marked)))
                yield from grams.add(marked[at] >> 1, np.where(marked[at] & 1, 0, n))

        for rows, raw, offsets in text_slices(batches):
            held = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for code, text in gram_pieces(raw, offsets, depth):
                codes.append(code << 1 | held[text])
                if sum(map(len, codes)) > 1 << 22:
                    yield from add_grams()
            keep = held == 0
            if not keep.any():
                continue
            if not keep.all():
                raw, offsets = raw[np.repeat(keep, np.diff(offsets))], np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])])
            yield from tokens.add(*np.unique(token_hashes(raw, offsets)[0], return_counts=True))
            yield from tokens.add(np.array([END_TOKEN]), np.array([keep.sum()]))
        yield from add_grams()
        yield from tokens.out()
        yield from grams.out()

    return _marked(docs).mapInArrow(count, "kind byte, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 0.5 or more."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    s = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / y - np.log(low)


def _estimates(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any order of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - np.log(np.pi)


def _at_depth(code: np.ndarray, cut: int, level: int) -> np.ndarray:
    """The nodes of grams: contexts without their `cut` earliest bytes, and the byte's first `level` bits below a 1."""
    return code >> (8 * (cut + 1)) << 8 | 1 << level | (code & 255) >> (8 - level)


def mix_parts(code: np.ndarray, n: np.ndarray, depth: int, split: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(chances, (node, n0, n1, below)) of the grams of whole parts.

    chances[i, level]: of that bit of gram i, by the contexts of split to depth bytes. The rest is for the nodes of
    split - 1 bytes: counts, and the logs of the weighted probabilities that the parts gave, summed.
    """
    chances = np.empty((len(code), 8), np.float32)
    left: list[tuple[np.ndarray, ...]] = []
    for level in range(8):
        one_bit = (code >> (7 - level) & 1).astype(bool)
        steps = []  # deepest first: (node of each gram, own estimate, chance of a one, weight of the own estimate)
        both = inner = None
        for d in range(depth, split - 1, -1):
            nodes, at = np.unique(_at_depth(code, depth - d, level), return_inverse=True)
            n0, n1 = np.bincount(at, np.where(one_bit, 0, n), len(nodes)), np.bincount(at, np.where(one_bit, n, 0), len(nodes))
            own = _estimates(n0, n1)
            if inner is None:
                both, weight = own, np.ones(len(nodes))
            else:
                up = np.empty(len(both), np.int64)
                up[inner] = at
                below = np.bincount(up, both, len(nodes))
                total = np.logaddexp(own, below)
                both, weight = total - np.log(2), np.exp(own - total)
            steps.append((at, (n1 + 0.5) / (n0 + n1 + 1), (n0 + 0.5) / (n0 + n1 + 1), weight))
            inner = at
        p = None
        for at, one, zero, weight in steps:
            own = np.where(one_bit, one[at], zero[at])
            p = own if p is None else weight[at] * own + (1 - weight[at]) * p
        chances[:, level] = p
        above, at = np.unique(nodes >> 16 << 8 | nodes & 255, return_inverse=True)
        left.append((above, *(np.bincount(at, x, len(above)) for x in (n0, n1, both))))
    return chances, tuple(np.concatenate(x) for x in zip(*left))


def mix_top(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, rest) for the nodes of split - 1 bytes, sorted: shares[bit] is the mixed chance of the depths from there up, rest the weight of what is below."""
    places, kept = [np.arange(len(node))], []
    for d in range(split - 1, -1, -1):
        own = _estimates(n0, n1)
        total = np.logaddexp(own, below)
        kept.append((np.exp(own - total), n0 / (n0 + n1 + 1) + 0.5 / (n0 + n1 + 1), n1 / (n0 + n1 + 1) + 0.5 / (n0 + n1 + 1)))
        if d:
            node, at = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
            n0, n1, below = (np.bincount(at, x, len(node)) for x in (n0, n1, total - np.log(2)))
            places.append(at[places[-1]])
    shares, rest = np.zeros((2, len(places[0]))), np.ones(len(places[0]))
    for (weight, *chance), at in zip(reversed(kept), reversed(places)):
        for bit in (0, 1):
            shares[bit] += rest * weight[at] * chance[bit][at]
        rest *= 1 - weight[at]
    return shares, rest


def gram_costs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, n, cost) for the grams of corpus_counts(): log10 of the mixed probability of the byte in its context."""
    spark = counts.sparkSession
    split = min(SPLIT, depth)
    grams = counts.where(F.col("kind") == _BYTE)
    parts = 1 + grams.count() // _PART

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        code, n = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
        chances, left = mix_parts(code, n, depth, split)
        names = ["code", "n", "chances", "n0", "n1", "below"]
        for k in range(0, len(code), 1 << 15):
            c = slice(k, k + (1 << 15))
            m = len(code[c])
            raw = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, 32 * m + 1, 32, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(chances[c]))])
            yield pa.RecordBatch.from_arrays([pa.array(code[c]), pa.array(n[c]), raw, *[pa.nulls(m, pa.float64())] * 3], names)
        for k in range(0, len(left[0]), 1 << 15):
            node, *rest = (x[k : k + (1 << 15)] for x in left)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.binary()), *map(pa.array, rest)], names)

    part = F.shiftright("code", 8 * (depth - split + 1))
    dealt = grams.select("code", "n").repartition(parts, part)
    mixed = written(dealt.mapInArrow(below, "code long, n long, chances binary, n0 double, n1 double, below double"), "mixed")
    top = mixed.where(F.col("chances").isNull()).groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).orderBy("code").toArrow()
    node, n0, n1, under = (top.column(c).to_numpy() for c in ("code", "n0", "n1", "below"))
    model = spark.sparkContext.broadcast((node, *mix_top(node, n0, n1, under, split)))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, shares, rest = model.value
        for rows in batches:
            if rows.num_rows:
                code = rows.column(0).to_numpy()
                chances = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.float32).reshape(-1, 8)
                total = np.zeros(len(code))
                for level in range(8):
                    at = np.searchsorted(have, _at_depth(code, depth - split + 1, level))
                    total += np.log10(shares[code >> (7 - level) & 1, at] + rest[at] * chances[:, level])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(total)], ["code", "n", "cost"])

    return mixed.where(F.col("chances").isNotNull()).select("code", "n", "chances").mapInArrow(cost, "code long, n long, cost double")


def _frequent(costs: DataFrame, most: int) -> int:
    """The least count from which on the grams are `most` at most."""
    step = F.floor(F.log2(F.col("n") + 1) * 8)
    least = None
    for n, rows in costs.groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("step")).select("n", "rows").collect():
        most -= rows
        if most < 0:
            break
        least = n
    return (1 << 62) if least is None else least


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes), one row for each of docs.

    score: log10 probability of the text by the byte model of 1 to 5 context bytes; base_score: by token counts with one
    added. A null or empty text is its end alone. Without any training text every count is 0 and every byte even.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is of 1 to 5 bytes: a gram and a row's place are one number of 64 bits")
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = written(corpus_counts(docs, depth), "counts")
    tokens = counts.where(F.col("kind") == _TOKEN).select(F.col("code").alias("token"), F.col("n").alias("c"))
    total, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = tokens.where(F.col("c") > total / (1 << _COMMON)).orderBy("token").toArrow()  # 2^_COMMON rows at most
    ends = tokens.where(F.col("token") == END_TOKEN).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast((frequent.column("token").to_numpy(), frequent.column("c").to_numpy()))
    costs = written(gram_costs(counts, depth), "costs")
    least = _frequent(costs, 1 << GRAMS)
    often = costs.where(F.col("n") >= least).select("code", F.col("cost").cast("float").alias("cost")).toArrow()  # 2^GRAMS rows at most
    codes = often.column("code").to_numpy()
    order = np.argsort(codes)
    table = spark.sparkContext.broadcast((codes[order], often.column("cost").to_numpy()[order]))
    del often, codes, order
    each = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (have, c), (grams, cost), row = known.value, table.value, TaskContext.get().partitionId() << 40
        if not len(have):
            have, c = np.array([END_TOKEN]), np.array([0])
        if not len(grams):
            grams, cost = np.array([-1]), np.array([0], np.float32)
        for rows, raw, offsets in text_slices(batches):
            n_rows = len(offsets) - 1
            text_score, missing = np.zeros(n_rows), [np.zeros((3, 0), np.int64)]
            for code, text in gram_pieces(raw, offsets, depth):
                met = code.view(np.uint64) << np.uint64(16) | text.view(np.uint64)
                met.sort()
                first = _runs(met)  # of a gram in a text
                times = np.diff(np.append(first, len(met)))
                met = met[first]
                code, text = (met >> np.uint64(16)).view(np.int64), (met & np.uint64(0xFFFF)).view(np.int64)
                new = _runs(code)
                place = np.minimum(np.searchsorted(grams, code[new]), len(grams) - 1)
                found = grams[place] == code[new]
                each_text = np.diff(np.append(new, len(code)))
                text_score += np.bincount(text, np.repeat(np.where(found, cost[place], 0), each_text) * times, n_rows)
                gone = ~np.repeat(found, each_text)
                missing.append(np.stack([text[gone], code[gone], times[gone]]))
            gone_text, gone_code, gone_times = np.concatenate(missing, axis=1)
            hashes, first = token_hashes(raw, offsets)
            n = np.diff(first) + 1
            token, which = np.unique(hashes, return_inverse=True)
            place = np.minimum(np.searchsorted(have, token), len(have) - 1)
            hit = have[place] == token
            base = ordered_sums(np.where(hit, np.log10(c[place] + 1.0), 0)[which], first) + np.log10(ends + 1.0) - n * each
            n_known = ordered_sums(hit[which].astype(np.int64), first) + (ends > 0)
            doc = np.repeat(np.arange(len(n)), n - 1)
            rare = ~hit[which]
            pair, seen = np.unique(doc[rare] * len(token) + which[rare], return_counts=True)
            of = np.concatenate([pair // max(1, len(token)), gone_text])
            order = np.argsort(of, kind="stable")
            begin = np.searchsorted(of[order], np.arange(len(n) + 1)).astype(np.int32)
            values = [np.repeat(np.array([_TOKEN, _BYTE], np.int8), [len(pair), len(gone_code)]), np.concatenate([token[pair % max(1, len(token))], gone_code]), np.concatenate([seen, gone_times]).astype(np.int32)]
            lists = pa.ListArray.from_arrays(pa.array(begin), pa.StructArray.from_arrays([pa.array(v[order]) for v in values], ["kind", "code", "times"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(n))), rows.column(0), rows.column(2), pa.array(n), pa.array(n_known), pa.array(base), pa.array(text_score), pa.array(np.diff(offsets)), lists],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare"],
            )
            row += len(n)

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<struct<kind:byte,code:long,times:int>>"
    scored = written(_marked(docs).mapInArrow(run, kinds), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.kind", "x.code", "x.times")
    values = tokens.select(F.lit(_TOKEN).cast("byte").alias("kind"), F.col("token").alias("code"), F.log10(F.col("c") + 1).alias("value")).unionByName(
        costs.where(F.col("n") < least).select(F.lit(_BYTE).cast("byte").alias("kind"), "code", F.col("cost").alias("value"))
    )
    is_token = F.col("kind") == _TOKEN
    met = rare.join(values, ["kind", "code"]).groupBy("row").agg(
        F.sum(F.when(is_token, F.col("times") * F.col("value"))).alias("more"), F.sum(F.when(is_token, F.col("times"))).alias("more_known"), F.sum(F.when(~is_token, F.col("times") * F.col("value"))).alias("more_score")
    )
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "n_bytes",
    )


def code_length(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, bits_per_byte): the code length by the byte model; the end counts as a byte."""
    return score(docs, depth).select("doc_id", (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(read_table(spark, sf_dir, "documents")).drop("n_bytes")
