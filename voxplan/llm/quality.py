"""Quality classifier by co-training.

Two views of a document: its text (hashed words and runs of symbols) and its metadata (language, source, length, and the
page's shape: shares of kinds of characters, of repeated words, and the length of lines). For each of two
targets, good quality and toxicity, a logistic model is fitted on either view from labelled documents. In each of ROUNDS
each view labels all unlabelled documents of which it is confident, and the other view learns from them: one pass sums,
for each feature, gradient and curvature of the other view's loss over the documents where it doesn't agree yet, and
features that are significant take a damped Newton step. A view is confident where labelled documents that neither view was
fitted on show it to be right (CONFIDENT); a round after which a view tells more of these wrong is taken back for that
view, one after which both together do for both. Scores of the two views are calibrated together on the same documents.

The first fit uses a bounded sample of labelled documents (LABELLED, by hash of the id, with at most SETS features), all
else looks at every document. Models are arrays of a fixed size (2^HASH_BITS weights for each view and target), so scoring
is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, bounded_batches, fresh, mix, prefix_hash, range_hash, read_table, text_slices, words, written

#: Labelled documents that the first fit looks at, at most, and their features (4 bytes each).
LABELLED = 12_000
SETS = 12_000_000
ROUNDS = 2
#: A round moves no document's logit by more than that, on average.
STEP = 4.0
#: A confident label counts where the other view's probability differs by that.
APART = 0.05
#: A feature counts if its shares in the two classes differ by so many standard errors.
SIGNIFICANT = 4.0
#: Documents that have the feature, at least.
SUPPORT = 5
CONFIDENT = 0.97
#: One of so many labelled documents is not fitted on, but tells where views are right.
HELD = 4
HASH_BITS = 20
TARGETS = ("quality", "toxic")
#: A document stays with at least this probability of good quality and at most this one of toxicity.
KEEP_QUALITY = 0.5
KEEP_TOXIC = 0.5

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_ALNUM & ~SPACE
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _bucketed(kind: int, bucket: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(bucket, np.int64).astype(np.uint64) + np.uint64(kind << 32)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def text_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first): each text's distinct hashed features, sorted: words and runs of symbols."""
    n = len(offsets) - 1
    low = LOWER[raw]
    hashed = prefix_hash(low)
    docs, features = [], []
    for inside in (_ALNUM, _SYMBOL):
        start, end, first = words(low, offsets, inside)
        docs.append(np.repeat(np.arange(n), np.diff(first)))
        features.append((range_hash(hashed, start, end) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    pair = np.unique(np.concatenate(docs) << HASH_BITS | np.concatenate(features))
    return pair & ((1 << HASH_BITS) - 1), np.searchsorted(pair, np.arange(n + 1) << HASH_BITS)


def metadata_features(rows: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As text_features, but a fixed number for each text: lang, source, and the text's length."""
    n, columns = rows.num_rows, []
    for kind, name in ((20, "lang"), (21, "source")):
        at = rows.schema.get_field_index(name)
        values = rows.column(at).to_pylist() if at >= 0 else [None] * n
        codes = {v: int.from_bytes(hashlib.blake2b(b"" if v is None else b"=" + str(v).encode(), digest_size=8).digest(), signed=True) for v in set(values)}
        columns.append(_bucketed(kind, np.array([codes[v] for v in values], np.int64)))
    columns.append(_bucketed(22, (2 * np.log2(np.maximum(np.diff(offsets), 1))).astype(int)))
    return np.stack(columns, axis=1).ravel(), np.arange(n + 1) * len(columns)


def shape_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text's shape, a row for each text: buckets of shares of kinds of characters, of repeated words, of length of lines."""
    n, size, columns = len(offsets) - 1, np.maximum(np.diff(offsets), 1), []
    for kind, mask in enumerate((_UPPER, _SYMBOL, _ALNUM)):
        total = np.concatenate([[0], np.cumsum(mask[raw])])
        columns.append(_bucketed(kind + 1, 20 * (total[offsets[1:]] - total[offsets[:-1]]) // size))
    # How many of the words are different ones, and how many repeat the word before.
    low = LOWER[raw]
    start, end, first = words(low, offsets)
    hashes = range_hash(prefix_hash(low), start, end)
    of, count = np.repeat(np.arange(n), np.diff(first)), np.maximum(np.diff(first), 1)
    mine = np.sort(of.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    kinds = np.bincount((mine[np.flatnonzero(np.diff(mine, prepend=~mine[:1]))] >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    columns.append(_bucketed(10, 10 * kinds // count + 100 * np.log2(count).astype(int)))
    columns.append(_bucketed(11, 20 * again // count))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    columns.append(_bucketed(12, (2 * np.log2(size / (lines[offsets[1:]] - lines[offsets[:-1]] + 1) + 1)).astype(int)))
    return np.stack(columns, axis=1)


def view_features(rows: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, first) of the text view and of the metadata view."""
    meta = np.concatenate([metadata_features(rows, offsets)[0].reshape(rows.num_rows, -1), shape_features(raw, offsets)], axis=1)
    return [text_features(raw, offsets), (meta.ravel(), np.arange(rows.num_rows + 1) * meta.shape[1])]


def _sets(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists' values, none of them null, as views of one array."""
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Logistic:
    """Logistic regression on sets of binary features, by adaptive stochastic gradients, over the significant features; classes weigh the same."""

    def __init__(self, seed: int = 5, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5):
        self.seed, self.epochs, self.rate, self.decay = seed, epochs, rate, decay
        self.weights, self.bias = np.zeros(1 << HASH_BITS), 0.0

    def logits(self, sets: list[np.ndarray]) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        total = np.concatenate([[0.0], np.cumsum(self.weights[np.concatenate([*sets, np.zeros(0, np.int32)])])])
        return total[first[1:]] - total[first[:-1]] + self.bias

    def fit(self, sets: list[np.ndarray], y: np.ndarray) -> Logistic:
        self.weights[:], self.bias = 0, 0.0
        ones, size = y.sum(), np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        a, b = (np.bincount(flat, np.repeat(c, size), 1 << HASH_BITS) for c in (y, 1 - y))
        share = (a + b) / len(y)
        spread = np.sqrt(share * (1 - share) * (1 / ones + 1 / (len(y) - ones))) + 1e-12
        counts = (np.abs(a / ones - b / (len(y) - ones)) >= SIGNIFICANT * spread) & (a + b >= SUPPORT)
        sets = [x[counts[x]] for x in sets]
        weigh = np.where(y == 1, 0.5 * len(y) / ones, 0.5 * len(y) / (len(y) - ones))
        rng, seen, seen_bias = np.random.default_rng(self.seed), np.full(1 << HASH_BITS, 1e-8), 1e-8
        for _ in range(self.epochs):
            order = rng.permutation(len(sets))
            for k in range(0, len(order), 64):
                part = order[k : k + 64]
                flat = np.concatenate([sets[i] for i in part])
                which = np.repeat(np.arange(len(part)), [len(sets[i]) for i in part])
                z = np.bincount(which, self.weights[flat], len(part)) + self.bias
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weigh[part] / len(part)
                used, at = np.unique(flat, return_inverse=True)
                g = np.bincount(at, error[which], len(used)) + self.decay * self.weights[used]
                seen[used] += g * g
                self.weights[used] -= self.rate * g / np.sqrt(seen[used])
                seen_bias += error.sum() ** 2
                self.bias -= self.rate * error.sum() / np.sqrt(seen_bias)
        return self


def logits(weights: np.ndarray, bias: float, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[features], dtype=float)])
    return total[first[1:]] - total[first[:-1]] + bias


#: Logits at most and at least which a view is confident, if nothing is known of it.
_SURE = (-np.log(CONFIDENT / (1 - CONFIDENT)), np.log(CONFIDENT / (1 - CONFIDENT)))


def sure(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logits at most and at least which a view is confident: those beyond which CONFIDENT of the documents (z, y), and of one wrong more, are of the class.

    Infinite where there are none, as for a view that can't tell the classes or for too few documents.
    """
    out = []
    for sign, hit in ((-1, y < 0.5), (1, y >= 0.5)):
        order = np.argsort(-sign * z, kind="stable")
        low, right = (sign * z)[order], np.cumsum(hit[order])
        ends = np.flatnonzero(np.append(np.diff(low) != 0, True)[: len(low)])  # equal logits go together
        good = ends[right[ends] >= CONFIDENT * (ends + 2)]
        out.append(sign * max(low[good[-1]], 0.0) if len(good) else sign * np.inf)
    return out[0], out[1]


def exchange(pool: DataFrame, models: dict[str, tuple[Logistic, Logistic]], confident: dict[str, list[tuple[float, float]]] | None = None) -> None:
    """One round of co-training on all documents (text_set, meta_set) of the pool; the models are changed in place.

    confident: for each target and view the logits at most and at least which its label is taken, by default those of odds CONFIDENT.
    What reaches the driver is one row for each significant feature at most, so it's bounded by the models' size.
    """
    shared = pool.sparkSession.sparkContext.broadcast({t: [(m.weights.astype(np.float32), m.bias) for m in views] for t, views in models.items()})
    confident = confident or {t: [_SURE, _SURE] for t in models}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = 2 * len(TARGETS)
        total = np.zeros((slots, 3, (1 << HASH_BITS) + 1), np.float32)  # gradient, curvature, documents; the bias last
        sizes = np.zeros(slots)
        for batch in batches:
            sets = []
            for c in range(2):
                x = batch.column(c)
                at = x.offsets.to_numpy().astype(np.int64)
                sets.append((x.flatten().to_numpy().astype(np.int64), at - at[0]))
            for k, t in enumerate(TARGETS):
                if t not in shared.value:
                    continue
                z = [logits(*m, *x) for m, x in zip(shared.value[t], sets)]
                p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z]
                for view in range(2):
                    other, (low, high), (features, at) = z[1 - view], confident[t][1 - view], sets[view]
                    error = p[view] - (other >= high)
                    learn = ((other >= high) | (other <= low)) & (np.abs(error) >= APART)
                    n = np.diff(at)
                    who = np.repeat(np.where(learn, np.arange(len(n)), -1), n)
                    of, features = who[who >= 0], features[who >= 0]
                    own = total[2 * k + view]
                    curve = p[view] * (1 - p[view])
                    for row, value in enumerate((error, curve, np.ones(len(n)))):
                        np.add.at(own[row], features, value[of].astype(np.float32))
                        own[row, -1] += value[learn].sum()
                    sizes[2 * k + view] += n[learn].sum()
        slot, feature = np.nonzero(total[:, 2])
        values = [total[slot, c, feature].astype(float) for c in range(3)]
        bias = feature == 1 << HASH_BITS
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(feature), *map(pa.array, values), pa.array(np.where(bias, sizes[slot], 0.0))], ["slot", "feature", "g", "h", "n", "size"])

    rows = pool.select("text_set", "meta_set").mapInArrow(sums, "slot long, feature long, g double, h double, n double, size double")
    rows = rows.groupBy("slot", "feature").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n", "size")))
    rows = rows.where((F.col("feature") == 1 << HASH_BITS) | ((F.col("n") >= SUPPORT) & (F.abs("g") >= SIGNIFICANT * F.sqrt("h")))).toArrow()
    slot, feature, g, h, n, size = (rows.column(c).to_numpy() for c in rows.column_names)
    for k, t in enumerate(TARGETS):
        for view in range(2):
            bias = (slot == 2 * k + view) & (feature == 1 << HASH_BITS)
            if t in models and bias.any():
                own = (slot == 2 * k + view) & (feature < 1 << HASH_BITS)
                each = max(1.0, n[own].sum() / n[bias][0])  # features of a document that move
                models[t][view].weights[feature[own]] -= np.clip(g[own] / (h[own] + 1), -1, 1) * STEP / each


def calibrate(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (a, b, 1) of a logistic model on two views' logits, by Newton's method with a small ridge; a view that would count against what it says counts as nothing."""
    x = np.stack([np.clip(a, -20, 20), np.clip(b, -20, 20), np.ones(len(a))], axis=1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - y) + 0.1 * w)
    if w[:2].min() < -1e-9:
        return calibrate(*(np.where(w[k] < 0, 0.0, x[:, k]) for k in range(2)), y)
    return w


def errors(y: np.ndarray, *views: np.ndarray) -> int:
    """How many documents one or two views' logits, calibrated, tell wrong."""
    z = [np.clip(x, -20, 20) for x in (*views, np.zeros(len(y)))[:2]]
    w = calibrate(*z, y)
    return int(np.sum((w[0] * z[0] + w[1] * z[1] + w[2] >= 0) != (y > 0.5)))


def one_of_each(sets: list[np.ndarray], classes: int = 4, least: int = 12) -> np.ndarray:
    """Marks the first of near copies: a group of copies would else pass its label on to its own words.

    Features fall into classes by hash; sets that have the same `least` features of lowest hash in some class are near
    copies, as are equal sets.
    """
    seen: set = set()
    out = np.ones(len(sets), bool)
    for i, x in enumerate(sets):
        h = np.sort(mix(x.astype(np.uint64) + np.uint64(1)))
        parts = [h[h % np.uint64(classes) == k] for k in range(classes)]
        keys = [hashlib.blake2b(h, digest_size=16).digest(), *(p[:least].tobytes() for p in parts if len(p) >= least)]
        out[i] = seen.isdisjoint(keys)
        seen.update(keys)
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_set, meta_set) of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32))) for f, at in view_features(rows, raw, offsets)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *made], ["doc_id", "text_set", "meta_set"])

    return docs.mapInArrow(run, "doc_id long, text_set array<int>, meta_set array<int>")


def unlabelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(text_set, meta_set) of the docs whose doc_id isn't in marks; of equal text sets that of the least doc_id counts.

    Which ones count is found by ids and hashes alone. So the sets are moved once, whatever the number of documents and labels.
    """
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    made = features(docs).select("doc_id", "text_set", "meta_set", F.xxhash64("text_set").alias("key"), who.alias("who"))
    chosen = made.select("doc_id", "key", "who").join(marks.select("doc_id"), "doc_id", "left_anti").groupBy("key").agg(F.min("who").alias("who"))
    # A row that is there twice is dropped where the join has put it; a broadcast would need a second shuffle for that.
    keys = ["key", "none", "id"]
    chosen = written(chosen.select("key", "who.*"), "chosen").hint("merge")
    return made.select("text_set", "meta_set", "key", "who.*").join(chosen, keys).dropDuplicates(keys).select("text_set", "meta_set")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, tuple]:
    """target: (text model, metadata model, calibration). A target without both classes gets its prior alone.

    A document with several labels is good if one says so, and toxic if one does. Of equal unlabelled texts one counts,
    and of near copies in the labelled sample the one of least hash of its id. No documents or no labels leave the prior.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(t).alias(t) for t in TARGETS))
    ids = docs.select("doc_id").distinct().join(marks, "doc_id").where("quality is not null and toxic is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = written(ids.orderBy(*order).limit(labelled), "chosen")
    columns = docs.select(*(c for c in ("doc_id", "text", "lang", "source") if c in docs.columns))
    # The sample is bounded by `labelled` and SETS, so it may be sent around and sorted as a whole.
    rows = features(columns.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    upto = F.sum(F.size("text_set")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SETS).toArrow()
    # Views of the columns: copies of eight bytes an element would be the most that the driver's Python holds.
    sets = [[part for chunk in rows.column(c).chunks for part in _sets(chunk)] for c in ("text_set", "meta_set")]
    have = one_of_each(sets[0])
    turn = mix(np.array(rows.column("doc_id").to_pylist(), np.int64).view(np.uint64)) % np.uint64(HELD) == 0
    pick = lambda c, which: [sets[c][i] for i in np.flatnonzero(which)]
    labels_of = {t: np.array([v or 0 for v in rows.column(t).to_pylist()], float) > 0 for t in TARGETS}
    fit, held = have & ~turn, have & turn
    views = {t: tuple(Logistic().fit(pick(c, fit), y[fit].astype(float)) for c in range(2)) for t, y in labels_of.items() if 0 < y[fit].sum() < fit.sum() and 0 < y[held].sum() < held.sum()}
    if views and rounds:
        pool = written(unlabelled(columns, marks), "pool")
        own = [pick(c, held) for c in range(2)]
        for _ in range(rounds):
            before = {t: [(m.weights.copy(), m.bias) for m in v] for t, v in views.items()}
            z = {t: [m.logits(x) for m, x in zip(v, own)] for t, v in views.items()}
            exchange(pool, views, {t: [sure(x, labels_of[t][held]) for x in v] for t, v in z.items()})
            for t, v in views.items():
                y = labels_of[t][held].astype(float)
                for m, x, was, old in zip(v, own, z[t], before[t]):
                    if errors(y, m.logits(x)) > errors(y, was):
                        m.weights, m.bias = old
                if errors(y, *(m.logits(x) for m, x in zip(v, own))) > errors(y, *z[t]):
                    for m, old in zip(v, before[t]):
                        m.weights, m.bias = old
    out = {}
    for t, y in labels_of.items():
        if t in views:
            a, b = views[t]
            out[t] = (a, b, calibrate(a.logits(pick(0, held)), b.logits(pick(1, held)), y[held].astype(float)))
        else:
            share = (y[have].sum() + 1) / (have.sum() + 2) if have.any() else float(t == "quality")
            out[t] = (Logistic(), Logistic(), np.array([0, 0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))]))
    return out


NAMES = [f"p_{t}{v}" for t in TARGETS for v in ("", "_text", "_meta")]


def scored(docs: DataFrame, models: dict[str, tuple], names: list[str] | None = None) -> DataFrame:
    """docs with p_quality, p_toxic and p_*_text, p_*_meta, the views' own probabilities, as the last six columns, by `names` if given; other columns stay.

    A column of docs that has such a name, in any case, stays too: the new one gets underscores at its end then.
    """
    names = names or [fresh(n, docs.columns) for n in NAMES]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({t: [(a.weights.astype(np.float32), a.bias), (b.weights.astype(np.float32), b.bias), w] for t, (a, b, w) in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in text_slices(batches):
            made = view_features(rows, raw, offsets)
            out = []
            for t in TARGETS:
                *views, w = shared.value[t]
                z = []
                for x, model in zip(made, views):
                    z.append(logits(*model, *x))
                both = w[0] * np.clip(z[0], -20, 20) + w[1] * np.clip(z[1], -20, 20) + w[2]
                out += [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in (both, *z)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *out], [*rows.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the columns of scored() and keep; a null or empty text is scored by what it has. No rows give none.

    Repeated rows get the same scores. Names that docs has already, in any case, get underscores at their end.
    """
    names = [fresh(n, docs.columns) for n in NAMES]
    return scored(docs, train(docs, labels), names).withColumn(fresh("keep", docs.columns), _good(names))


def _good(names: list[str]) -> Column:
    return (F.col(names[NAMES.index("p_quality")]) >= KEEP_QUALITY) & (F.col(names[NAMES.index("p_toxic")]) <= KEEP_TOXIC)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep, and the views' probabilities) of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = classify(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_quality", "p_toxic", "keep", "p_quality_text", "p_quality_meta", "p_toxic_text", "p_toxic_meta")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; columns stay as they are."""
    names = [fresh(n, docs.columns) for n in NAMES]
    return scored(docs, train(docs, labels), names).where(_good(names)).drop(*names)
