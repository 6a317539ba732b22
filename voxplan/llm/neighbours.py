"""Nearest vectors by largest inner product, found by counting collisions in windows around the query.

Vectors get one more coordinate, sqrt(M * M - |x|^2) with M the greatest length, and queries are stretched to length M; then the
largest inner product is the least Euclidean distance. A block of vectors is indexed by PROJECTIONS sorted arrays, one for
each projection. A query opens a window of half-width WIDTH * R around its own projection in every array; a vector collides as
often as it lies in one. Growing R widens the windows (virtual rehashing: only what a window newly covers is counted, no second
table is made). A vector with `threshold` collisions is verified: its inner product is computed from the original numbers. A vector at
distance R has so many collisions or more with the probability that SURE standard deviations leave room for, a nearer one with a
higher one, so a query is through when R has reached its distance to the last neighbour that is asked for.

Equal vectors are one class with its least ids, searched once, so a vector that a third of all rows have costs no more
than another. Queries meet classes in a grid: blocks of classes by chunks of queries, each cell a task of bounded size.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

NEAREST = 20
PROJECTIONS = 64
WIDTH = 1.2
SURE = 1.5
#: R grows by this factor from one round to the next, from START times the bound.
GROWTH = 1.25
START = 0.8
#: Vectors whose distances bound R from above, and numbers in them; classes of a block, numbers in them, and queries of a chunk, at most about.
SAMPLE, SAMPLE_NUMBERS = 4096, 1 << 22
BLOCK, BLOCK_NUMBERS = 16384, 1 << 23
CHUNK = 4096
#: Parts that the queries of one class are dealt to when they get its neighbours.
_COPIES = 16


@functools.lru_cache(maxsize=4)
def projections(dim: int, many: int = PROJECTIONS) -> np.ndarray:
    """(many, dim) random projections, orthogonal among each `dim` of them, of length sqrt(dim) as Gaussian ones have on average."""
    random, out = np.random.default_rng(20240612), []
    while sum(map(len, out)) < many:
        out.append(np.linalg.qr(random.normal(size=(dim, min(dim, many))))[0].T)
    return np.concatenate(out)[:many] * math.sqrt(dim)


def threshold(many: int = PROJECTIONS, width: float = WIDTH, sure: float = SURE) -> int:
    """Collisions that a vector at distance R or less has in windows of half-width `width` * R but for `sure` standard deviations."""
    p = math.erf(width / math.sqrt(2))
    return max(1, int(many * p - sure * math.sqrt(many * p * (1 - p))))


class SortedArrays:
    """The index of a block of vectors (n, dim) whose greatest length is `longest`."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors, self.longest = vectors, longest
        rest = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))
        at = np.column_stack([vectors, rest]) @ projections(vectors.shape[1] + 1).T
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.at = np.ascontiguousarray(np.take_along_axis(at.T, self.order, axis=1))
        self.place = np.empty(self.order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)  # each vector's place in each array
        np.put_along_axis(self.place, self.order, np.broadcast_to(np.arange(len(vectors), dtype=self.place.dtype), self.order.shape), axis=1)

    def _met(self, lo: list[int], hi: list[int]) -> np.ndarray:
        """How many of the windows lo..hi each vector lies in: for wide windows, by all places; else by what the windows hold."""
        n, kind = len(self.vectors), self.place.dtype.type
        if sum(hi) - sum(lo) > n * len(lo) // 8:
            met = np.zeros(n, np.uint16)
            for place, s, e in zip(self.place, lo, hi):
                met += place - kind(s) < kind(e - s)  # places before s wrap around
            return met
        return np.bincount(np.concatenate([o[s:e] for o, s, e in zip(self.order, lo, hi)]), minlength=n)

    def search(self, query: np.ndarray, bound: float, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, inner products) of the `many` nearest among the verified vectors, with all that tie; bound: a distance that so many of all vectors don't exceed."""
        n, dim = self.vectors.shape
        score, count, need = np.full(n, -np.inf), np.zeros(n, np.int64), threshold()
        length = math.sqrt(float((query * query).sum()))
        sane = math.isfinite(self.longest) and length > 0  # else every window is endless
        centre = (projections(dim + 1)[:, :dim] @ (query * (self.longest / length) if sane else query)).tolist()
        left = right = None
        top = np.zeros(0)  # the best `many` scores so far
        radius = START * bound if sane else np.inf
        while True:
            reach = WIDTH * radius
            lo = [int(a.searchsorted(c - reach, "left")) if reach < np.inf else 0 for a, c in zip(self.at, centre)]
            hi = [int(a.searchsorted(c + reach, "right")) if reach < np.inf else n for a, c in zip(self.at, centre)]
            if left is None:
                count += self._met(lo, hi)
            else:
                new = [o[s:e] for o, s, e in zip(self.order, lo, left)] + [o[s:e] for o, s, e in zip(self.order, right, hi)]
                count += np.bincount(np.concatenate(new), minlength=n)
            left, right = lo, hi
            fit = np.flatnonzero((count >= need) & (score == -np.inf))
            score[fit] = new = self.vectors.take(fit, axis=0) @ query
            top = np.concatenate([top, new])
            if len(top) >= many:
                top = np.partition(top, len(top) - many)[-many:]
            last = top.min() if len(top) >= many else -np.inf
            far = min(bound, math.sqrt(max(0.0, 2 * self.longest * (self.longest - last / length)))) if sane and last > -np.inf else bound
            if radius >= far:
                break
            radius = min(radius * GROWTH, far)
        near = np.flatnonzero((score > -np.inf) & (score >= last - 1e-9 * (1 + abs(last)) * (1 + self.longest * length)))
        exact = (self.vectors[near] * query).sum(axis=1)  # a row's sum doesn't depend on the rows around it, as in a matrix product
        if len(near) > many:
            best = exact >= np.partition(exact, -many)[-many]
            return near[best], exact[best]
        return near, exact


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid(vectors: DataFrame, row_id: str, column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each once; the vector as it is, or as doubles if its numbers aren't floats."""
    vector = F.col(column) if dict(vectors.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")
    out = vectors.select(F.col(row_id).cast("long").alias("vec_id"), vector.alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out.where(F.col("vec_id").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, is_query, nearest: int = NEAREST, row_id: str = "vec_id", column: str = "embedding", block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors whose id makes is_query(id column) true its nearest rows, by rank.

    score is the inner product of the original vectors in double precision; equal ones are ranked by vec_id. Ids that are
    null, and vectors that are null, empty, zero, or hold null or non-finite numbers, take no part; vectors of another length than the query's
    are no candidates of it. Rows equal in id and vector count once; rows that share an id but no vector are rows of their own, and
    a query leaves out its own row alone. Where there are fewer candidates, a query has fewer rows. Other columns play no part; no rows give no rows.
    """
    spark, many = vectors.sparkSession, nearest + 1
    rows = written(valid(vectors, row_id, column), "vectors")
    query = is_query(F.col("vec_id"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    classes = rows.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= many).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(query).select("vector").distinct().withColumn("asked", F.lit(True))
    classes = written(classes.join(asked, "vector", "left").select(F.monotonically_increasing_id().alias("cid"), F.size("vector").alias("dim"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "classes")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    known = {r["dim"]: r for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.count_if("asked").alias("asked")).collect()}  # a row for each length of vectors
    share = F.create_map(*[F.lit(x) for d, r in known.items() for x in (d, min(sample, SAMPLE_NUMBERS // d + many) / r["n"])])[F.col("dim")] if known else F.lit(0.0)
    picked = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < share * (1 << 20)).select("dim", "vector").toArrow()  # about `sample` of each length
    dims = picked.column("dim").to_numpy()
    held = spark.sparkContext.broadcast({d: (_matrix(picked.filter(pa.array(dims == d)).column("vector"), d), r["longest"]) for d, r in known.items()})

    def bounds(batches):
        for batch in batches:
            out = np.full(batch.num_rows, np.inf)
            which = batch.column(1).to_numpy()
            for d in np.unique(which).tolist():
                near, longest = held.value[d]
                own = np.flatnonzero(which == d)
                if len(near) < many:
                    continue
                for k in range(0, len(own), 256):
                    q = _matrix(pa.chunked_array([batch.column(2).take(pa.array(own[k : k + 256]))]), d)
                    last = -np.partition(-(q @ near.T), many - 1, axis=1)[:, many - 1]
                    with np.errstate(all="ignore"):
                        out[own[k : k + 256]] = np.nan_to_num(np.sqrt(np.maximum(2 * longest * (longest - last / np.sqrt((q * q).sum(axis=1))), 0)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["cid", "dim", "vector", "bound"])

    number = lambda column, most: F.create_map(*[F.lit(x) for d, r in known.items() for x in (d, max(1, -(-r[column] // most(d))))])[F.col("dim")] if known else F.lit(1)
    blocks = number("n", lambda d: min(block, BLOCK_NUMBERS // (d + PROJECTIONS) + 1))
    chunks = number("asked", lambda d: chunk)
    deal = lambda many: F.pmod(F.xxhash64("vector", F.lit(1)), many).cast("int")
    grid = classes.select("dim", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "cid", "vector", "ids")
    queries = classes.where("asked").select("cid", "dim", "vector").mapInArrow(bounds, f"cid long, dim int, vector {dict(classes.dtypes)['vector']}, bound double")
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), deal(chunks).alias("chunk"), "cid", "vector", "bound")

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asking.num_rows:
            dim = own.column("dim")[0].as_py()
            index, cid = SortedArrays(_matrix(own.column("vector"), dim), held.value[dim][1]), own.column("cid").to_numpy()
            ids = own.column("ids").to_pylist()
            for q, vector, bound in zip(asking.column("cid").to_pylist(), _matrix(asking.column("vector"), dim), asking.column("bound").to_pylist()):
                near, scores = index.search(vector, bound, many)
                best = sorted((-s, i, c) for s, k, c in zip(scores.tolist(), near.tolist(), cid[near].tolist()) for i in ids[k])[:many]
                out += [(q, i, c, -s) for s, i, c in best]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query", "vec_id", "cid", "score"])

    keys = ("dim", "block", "chunk")
    found = grid.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query long, vec_id long, cid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "cid")
    lists = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= many).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "cid", "score"))).alias("near"))
    lists = lists.join(classes.select(F.col("cid").alias("query"), "vector"), "query")
    copy = F.pmod(F.xxhash64("vec_id"), F.lit(_COPIES))
    asking = rows.where(query).withColumn("copy", copy)
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_COPIES - 1).cast("long"))))
    answers = asking.join(lists, ["vector", "copy"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: (x["vec_id"] != F.col("vec_id")) | (x["cid"] != F.col("query"))), 1, nearest).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op12_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The NEAREST vectors of each embedding whose vec_id is divisible by 20, among all others."""
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
