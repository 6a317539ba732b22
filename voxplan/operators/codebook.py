"""Vector quantisation: a codebook by repeated splitting, nearest-centroid assignment, symbol sequences.

Only the codebook (at most a few hundred vectors) is on the driver; frames stay distributed, and each pass reduces them to
a sum and a count for each centroid before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxplan import schema

LSF_SPLIT = (1.01, 0.99)
MFCC_SPLIT = (1.001, 0.999)


def initial_centroid(frames: DataFrame, column: str = "mfcc") -> DataFrame:
    """(id 0, vec): the mean of all frames."""
    each = frames.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v"))
    return each.agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_v")).select(F.lit(0).alias("id"), F.col("_v.v").alias("vec"))


def split_codebook(codebook: DataFrame, a1: float = MFCC_SPLIT[0], a2: float = MFCC_SPLIT[1]) -> DataFrame:
    """Centroid i becomes 2i (times a1) and 2i+1 (times a2); a codebook whose size is no power of two stays as it is."""
    size = codebook.agg(F.count("*").alias("n"))
    whole = codebook.crossJoin(F.broadcast(size))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    twice = F.array(F.struct((F.col("id") * 2).alias("id"), F.transform("vec", lambda v: v * a1).alias("vec")), F.struct((F.col("id") * 2 + 1).alias("id"), F.transform("vec", lambda v: v * a2).alias("vec")))
    same = F.array(F.struct("id", "vec"))
    return whole.select(F.explode(F.when(power, twice).otherwise(same)).alias("c")).select("c.id", "c.vec")


def codebook_array(codebook: DataFrame, column: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(codebook.select("id", column).collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def distances(x: np.ndarray, centroids: np.ndarray, metric: str, skip_first: bool) -> np.ndarray:
    """euclidean: on all but the first dimension if skip_first; itakura_saito: |r0 ra0 + 2 sum r_n ra_n| with ra the autocorrelation of the centroid's coefficients."""
    if metric == "euclidean":
        a, b = (x[:, 1:], centroids[:, 1:]) if skip_first else (x, centroids)
        out = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            out += (a[:, d, None] - b[None, :, d]) ** 2
        return np.sqrt(out)
    n = centroids.shape[1]
    ra = np.stack([(centroids[:, : n - k] * centroids[:, k:]).sum(axis=1) for k in range(n)], axis=1)
    weight = np.where(np.arange(n) == 0, 1.0, 2.0)
    return np.abs((x[:, :n] * weight) @ ra.T)


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str, skip_first: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(row of the nearest centroid, distance, distances computed in full) for each row of x; the first of equally near ones, and row 0 at infinity for what is no number.

    A matrix product gives squared Euclidean distances up to rounding; only centroids within that of the least one are
    compared in full, so rows and distances are those of distances().
    """
    if metric != "euclidean":
        d = distances(x, centroids, metric, skip_first)
        d = np.where(np.isnan(d), np.inf, d)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near], d.size
    a, b = (x[:, 1:], centroids[:, 1:]) if skip_first else (x, centroids)
    with np.errstate(all="ignore"):
        lengths = (b * b).sum(axis=1)
        rough = (a * a).sum(axis=1)[:, None] + lengths - 2 * (a @ b.T)
        slack = 64 * np.finfo(float).eps * ((a * a).sum(axis=1) + lengths.max()) * max(1, a.shape[1])
        listed = ~(rough > (rough.min(axis=1) + slack)[:, None])  # all of them where there are no numbers
    row, c = np.nonzero(listed)
    total = np.zeros(len(row))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            total += (a[row, d] - b[c, d]) ** 2
    total = np.sqrt(np.where(np.isnan(total), np.inf, total))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, first) if len(first) else total
    best = np.flatnonzero(total == np.repeat(least, np.diff(first, append=len(row))))
    _, at = np.unique(row[best], return_index=True)  # the first of the least
    return c[best[at]], least, len(row)


def assign_nearest(frames: DataFrame, codebook: DataFrame | tuple[np.ndarray, np.ndarray], column: str = "mfcc", metric: str = "euclidean", skip_first: bool = True) -> DataFrame:
    """frames with parent_centroid_id and distance; the least id of equally near ones, and id 0 for features that are no numbers."""
    ids, centroids = codebook if isinstance(codebook, tuple) else codebook_array(codebook, "lpc" if metric == "itakura_saito" and "lpc" in codebook.columns else "vec")
    names = ("parent_centroid_id", "distance")
    base = frames.drop(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = np.stack([np.asarray(v, float) for v in rows[column]])
                near, d, _ = (np.concatenate(y) if np.ndim(y[0]) else sum(y) for y in zip(*(nearest(x[k : k + 4096], centroids, metric, skip_first) for k in range(0, len(x), 4096))))
                rows = rows.assign(parent_centroid_id=ids[near].astype(np.int32), distance=d)
                yield rows

    kind = T.StructType([*base.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.DoubleType())])
    return base.mapInPandas(run, kind)


def update_codebook(assigned: DataFrame, k: int, column: str = "mfcc", width: int = 13) -> DataFrame:
    """(id, vec) for ids below k: the mean of the frames assigned to it, zeros where there are none."""
    means = assigned.select("parent_centroid_id", F.posexplode(column).alias("pos", "v")).groupBy("parent_centroid_id", "pos").agg(F.avg("v").alias("v"))
    means = means.groupBy(F.col("parent_centroid_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_v")).select("id", F.col("_v.v").alias("vec"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("id"))
    return every.join(F.broadcast(means), "id", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))  # means: k rows at most


def _pass(frames: DataFrame, ids: np.ndarray, centroids: np.ndarray, column: str, metric: str, skip_first: bool, judge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(sums, counts, total distance, distances computed in full) of one assignment; a row for each centroid and task is all that moves."""
    k, width = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, total, full = np.zeros((k, width)), np.zeros(k), np.zeros(k), 0
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack([np.asarray(v, float) for v in rows[column]])
            by = x if metric == "euclidean" else np.stack([np.asarray(v, float) for v in rows["autocorr"]])
            for s in range(0, len(x), 4096):
                near, d, compared = nearest(by[s : s + 4096], judge, metric, skip_first)
                full += compared
                np.add.at(sums, near, x[s : s + 4096])
                counts += np.bincount(near, minlength=k)
                total += np.bincount(near, d, minlength=k)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"c": used, "sums": pd.Series(list(sums[used]), dtype=object), "n": counts[used], "d": total[used], "m": [float(full)] * (len(used) > 0) + [0.0] * (len(used) - 1)})

    rows = frames.mapInPandas(run, "c int, sums array<double>, n double, d double, m double").select("c", F.posexplode("sums").alias("pos", "v"), "n", "d", "m")
    rows = rows.groupBy("c", "pos").agg(*(F.sum(x).alias(x) for x in ("v", "n", "d", "m"))).collect()
    sums, counts, total, full = np.zeros((k, width)), np.zeros(k), 0.0, 0.0
    for r in rows:
        sums[r["c"], r["pos"]], counts[r["c"]] = r["v"], r["n"]
        total, full = (total + r["d"], full + r["m"]) if r["pos"] == 0 else (total, full)
    return sums, counts, total, full


def train_codebook(frames: DataFrame, k: int = 256, max_iter: int = 100, eps: float = 0.001, feature: str = "mfcc", metric: str = "euclidean") -> dict[str, DataFrame]:
    """codebook, generations, assigned frames and log (generation, iteration, distance, diff, compared: distances computed in full).

    Per generation the codebook doubles and is refined until the total distance changes by eps at most or max_iter passes
    are made. The assigned frames are those of the last pass, so of the codebook one update earlier. k = 1 is the mean.
    """
    spark = frames.sparkSession
    skip_first, a = feature == "mfcc", MFCC_SPLIT if feature == "mfcc" else LSF_SPLIT
    columns = [c for c in (*schema.KEY, "frame_number", feature, "autocorr") if c in frames.columns]
    kept = frames.select(*columns).persist()
    try:
        centroids = np.array([initial_centroid(kept, feature).first()["vec"]])
        generations, log, judged = [centroids], [], centroids
        for generation in range(1, int(np.log2(k)) + 1):
            centroids = np.stack([centroids * a[0], centroids * a[1]], axis=1).reshape(-1, centroids.shape[1])
            before = 0.0
            for iteration in range(1, max_iter + 1):
                judged = centroids
                sums, counts, total, full = _pass(kept, np.arange(len(centroids)), centroids, feature, metric, skip_first, _judge(centroids, metric))
                centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], 0.0)
                diff, before = abs(before - total), total
                log.append((generation, iteration, float(total), float(diff), int(full)))
                if diff <= eps:
                    break
            generations.append(centroids)
    finally:
        kept.unpersist()
    book = [(i, v.tolist()) for i, v in enumerate(centroids)]
    past = [(g, i, v.tolist()) for g, c in enumerate(generations) for i, v in enumerate(c)]
    near = (np.arange(len(judged)), _judge(judged, metric))
    assigned = assign_nearest(frames, near, "autocorr" if metric == "itakura_saito" else feature, metric, skip_first)
    return {
        "codebook": spark.createDataFrame(book, schema.CODEBOOK),
        "generations": spark.createDataFrame(past, schema.GENERATIONS),
        "assigned": assigned.withColumn("generation", F.lit(len(generations) - 1)),
        "log": spark.createDataFrame(log, "generation int, iteration int, distance double, diff double, compared long"),
    }


def _judge(centroids: np.ndarray, metric: str) -> np.ndarray:
    """What frames are compared with: line spectral centroids give their prediction coefficients to the Itakura-Saito distance."""
    if metric == "euclidean":
        return centroids
    from voxplan.functions.kernels import lsf_to_lpc

    return lsf_to_lpc(centroids)


def quantize(frames: DataFrame, codebook: DataFrame | tuple[np.ndarray, np.ndarray], column: str = "mfcc") -> DataFrame:
    """(word, recording, obs): the symbols of each recording's frames, in order."""
    symbols = assign_nearest(frames.select(*schema.KEY, "frame_number", column), codebook, column)
    ordered = symbols.groupBy(*schema.KEY).agg(F.array_sort(F.collect_list(F.struct("frame_number", "parent_centroid_id"))).alias("_s"))
    return ordered.select(*schema.KEY, F.col("_s.parent_centroid_id").alias("obs"))


def training_summary(assigned: DataFrame) -> DataFrame:
    """(total_frames, max_generation, centroid_assignments), one row."""
    each = assigned.groupBy("parent_centroid_id").agg(F.count("*").alias("n"), F.max("generation").alias("g"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_frames"), F.max("g").alias("max_generation"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("parent_centroid_id", "n")))).alias("centroid_assignments"))
