"""Left-right hidden Markov models of discrete symbols, one for each word, trained for all words in one job.

Sequences are distributed by recording. In each pass a task computes forward and backward variables for its sequences
(those of one word and length at once) and emits log sums for each word and cell; a grouped log-sum-exp reduces them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxplan import schema
from voxplan.functions.kernels import _lse, forward_last, posteriors
from voxplan.functions.logmath import log_sum_exp_by

PI = [0.97, 0.02, 0.005, 0.005]
A = [[0.6, 0.4, 0.0, 0.0], [0.0, 0.6, 0.4, 0.0], [0.0, 0.0, 0.6, 0.4], [0.0, 0.0, 0.0, 1.0]]
#: The probability of a symbol that a state has never given.
UNSEEN = 1e-20
#: Models of one tensor, and numbers that a kernel's largest arrays have, at most about.
BLOCK = 256
NUMBERS = 1 << 22
_LONG = "word string, kind string, i int, j int, v double"


def initial_model(words: DataFrame, symbols: int, states: int = 4, warm: DataFrame | None = None) -> DataFrame:
    """A model for each word: left-right with even symbols, or the warm one of the word if it has as many states and symbols."""
    if states != len(PI):
        raise ValueError(f"the default model has {len(PI)} states")
    lit = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    even = F.array_repeat(F.array_repeat(F.lit(1.0 / symbols), symbols), states)
    out = words.select("word").distinct().select("word", F.lit(states).alias("states"), F.lit(symbols).alias("symbols"), lit(A).alias("A"), even.alias("B"), F.array(*map(F.lit, PI)).alias("Pi"))
    if warm is None:
        return out
    known = warm.where((F.col("states") == states) & (F.col("symbols") == symbols)).select("word", *(F.col(c).alias(f"_{c}") for c in ("A", "B", "Pi")))
    return out.join(known, "word", "left").select("word", "states", "symbols", *(F.coalesce(f"_{c}", c).alias(c) for c in ("A", "B", "Pi")))


def long_form(models: DataFrame) -> DataFrame:
    """(word, kind a|b|pi, i, j, p) of models."""
    parts = [models.select("word", F.lit(kind).alias("kind"), F.posexplode(c).alias("i", "row")).select("word", "kind", "i", F.posexplode("row").alias("j", "p")) for kind, c in (("a", "A"), ("b", "B"))]
    return parts[0].union(parts[1]).union(models.select("word", F.lit("pi").alias("kind"), F.posexplode("Pi").alias("i", "p")).select("word", "kind", "i", F.lit(0).alias("j"), "p"))


def log_arrays(models: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """word: (log A, log B, log Pi); one model for each word reaches the driver."""
    with np.errstate(divide="ignore"):
        return {r["word"]: tuple(np.log(np.array(r[c], float)) for c in ("A", "B", "Pi")) for r in models.collect()}


def _sequences(rows: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame, np.ndarray]]:
    """Parts of one `by` and length with their observations stacked; empty sequences are left out."""
    if not len(rows):
        return
    rows = rows.assign(_n=[len(x) for x in rows["obs"]])
    for key, part in rows[rows["_n"] > 0].groupby([*by, "_n"]):
        yield key, part, np.stack(part["obs"].to_list()).astype(int)


def _sliced(rows: pd.DataFrame, by: list[str], cells: int) -> Iterator[tuple[tuple, pd.DataFrame, np.ndarray]]:
    """As _sequences, in slices of so many sequences that each, of `cells` numbers, leaves NUMBERS at most."""
    for key, part, obs in _sequences(rows, by):
        many = max(1, NUMBERS // cells)
        for k in range(0, len(obs), many):
            yield key, part[k : k + many], obs[k : k + many]


def _stacked(logs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, log A, log B, log Pi) of models of one size as tensors of BLOCK models at most."""
    sizes: dict[tuple, list[str]] = {}
    for word in sorted(logs):
        sizes.setdefault(logs[word][1].shape, []).append(word)
    for words in sizes.values():
        for k in range(0, len(words), BLOCK):
            part = words[k : k + BLOCK]
            yield part, *(np.stack([logs[w][i] for w in part]) for i in range(3))


def _scored(rows: pd.DataFrame, logs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], best: bool) -> Iterator[pd.DataFrame]:
    """(word, recording, model_word, loglik) of rows under all models, or their likeliest alone, the first by word of equally likely ones."""
    top: dict[int, tuple[float, str]] = {}
    for words, a, b, pi in _stacked(logs):
        said = np.array(words, object)
        for _, part, obs in _sliced(rows, [], len(words) * a.shape[1] * a.shape[1]):
            p = forward_last(obs, a, b, pi)
            if not best:
                yield pd.DataFrame({"word": np.tile(part["word"], len(said)), "recording": np.tile(part["recording"], len(said)), "model_word": np.repeat(said, len(part)), "loglik": p.ravel()})
                continue
            at = p.argmax(axis=0)
            for row, cost, word in zip(part.index.tolist(), (-p[at, np.arange(len(part))]).tolist(), said[at].tolist()):
                top[row] = min(top.get(row, (cost, word)), (cost, word))
    if top:
        out = rows.loc[list(top), ["word", "recording"]]
        yield out.assign(model_word=[w for _, w in top.values()], loglik=[-c for c, _ in top.values()])


_SCORES = "word string, recording string, model_word string, loglik double"


def forward_loglik(sequences: DataFrame, models: DataFrame, best: bool = False) -> DataFrame:
    """(word, recording, model_word, loglik) of every sequence under every model, or only under its likeliest one (the
    first by word of equally likely ones); every task has all models, so this is for some hundreds of them."""
    logs = log_arrays(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from _scored(rows.reset_index(drop=True), logs, best)

    return sequences.select(*schema.KEY, "obs").mapInPandas(run, _SCORES)


def forward_loglik_blocks(sequences: DataFrame, models: DataFrame, best: bool = False, block: int = 256, symbols: int = 1 << 22) -> DataFrame:
    """As forward_loglik, for any number of models: blocks of about `block` models meet parts of about `symbols` symbols in a grid, a task for each cell.

    No model reaches the driver. With best, a cell gives its winner for each sequence, and these partial winners are merged
    before and after one shuffle. Sequences are told apart by word and recording; two models of a word are two models.
    """
    sizes = sequences.agg(F.coalesce(F.sum(F.size("obs")), F.lit(0)).alias("n")).first()
    parts, blocks = -(-sizes["n"] // symbols) or 1, -(-models.count() // block) or 1
    cell = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = models.select(F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"), cell(parts, "part"), F.col("word").alias("model_word"), "A", "B", "Pi")
    right = sequences.select(*schema.KEY, "obs", cell(blocks, "block"), F.pmod(F.xxhash64(*schema.KEY), F.lit(parts)).cast("int").alias("part"))

    def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(divide="ignore"):
            logs = {f"{w}\0{i}": tuple(np.log(np.array([list(x) for x in m] if k < 2 else list(m), float)) for k, m in enumerate(abp)) for i, (w, *abp) in enumerate(zip(own["model_word"], own["A"], own["B"], own["Pi"]))}
        out = list(_scored(rows.reset_index(drop=True), logs, best)) if len(own) and len(rows) else []
        rows = [(w, r, m.rsplit("\0", 1)[0], p) for part in out for w, r, m, p in part[["word", "recording", "model_word", "loglik"]].itertuples(index=False, name=None)]
        return pd.DataFrame(rows, columns=["word", "recording", "model_word", "loglik"])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, _SCORES)
    if not best:
        return met
    won = met.groupBy(*schema.KEY).agg(F.min(F.struct((-F.col("loglik")).alias("cost"), "model_word")).alias("b"))
    return won.select(*schema.KEY, "b.model_word", (-F.col("b.cost")).alias("loglik"))


def forward_backward(sequences: DataFrame, models: DataFrame, block: int | None = None) -> DataFrame:
    """(word, recording, t, kind, i, j, v): log gamma (kind gamma, j 0) and log xi (kind xi) under the word's own model; log P as kind loglik.

    Times are worked on in blocks (posteriors()), so a recording's length doesn't bound what a task can do."""
    logs = log_arrays(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (word, n), part, obs in _sliced(rows[rows["word"].isin(list(logs))], ["word"], _cells(rows, logs)):
                p, blocks = posteriors(obs, *logs[word], block)
                names = part["recording"].to_numpy()
                yield pd.DataFrame({"word": word, "recording": names, "t": 0, "kind": "loglik", "i": 0, "j": 0, "v": p})
                for first, gamma, xi in blocks:
                    for kind, values in (("gamma", gamma[..., None]), ("xi", xi)):
                        r, t, i, j = (x.ravel() for x in np.indices(values.shape))
                        yield pd.DataFrame({"word": word, "recording": names[r], "t": t + first, "kind": kind, "i": i, "j": j, "v": values.ravel()})

    return sequences.select(*schema.KEY, "obs").mapInPandas(run, "word string, recording string, t int, kind string, i int, j int, v double")


def _cells(rows: pd.DataFrame, logs: dict) -> int:
    """Numbers that posteriors() has in memory for the longest of some sequences, about."""
    states = max((len(m[2]) for m in logs.values()), default=1)
    longest = max(map(len, rows["obs"]), default=1)
    return (math.isqrt(longest) + 1) * states * (states + 4)


def statistics(sequences: DataFrame, logs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], block: int | None = None) -> DataFrame:
    """(word, kind, i, j, v): log sums of expected counts. Kinds: pi, a, a_all, b, b_all, n (recordings), p (likelihoods) and total (sum of log P, not a log).

    A task keeps one array for each word and kind, to which each block of times is added as it comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[tuple[str, str], np.ndarray] = {}

        def add(word: str, kind: str, values: np.ndarray) -> None:
            known = have.get((word, kind))
            have[word, kind] = values if known is None else known + values if kind == "total" else np.logaddexp(known, values)

        for rows in batches:
            for (word, n), _, obs in _sliced(rows[rows["word"].isin(list(logs))], ["word"], _cells(rows, logs)):
                p, blocks = posteriors(obs, *logs[word], block)
                add(word, "n", np.array([[np.log(len(p))]]))
                add(word, "p", _lse(p[:, None, None], 0))
                add(word, "total", np.array([[p[np.isfinite(p)].sum()]]))
                for first, gamma, xi in blocks:
                    states = gamma.shape[2]
                    flat, symbol = gamma.reshape(-1, states), obs[:, first : first + gamma.shape[1]].ravel()
                    if not first:
                        add(word, "pi", _lse(gamma[:, 0], 0)[:, None])
                    if xi.shape[1]:
                        add(word, "a", _lse(xi.reshape(-1, states, states), 0))
                        add(word, "a_all", _lse(gamma[:, : xi.shape[1]].reshape(-1, states), 0)[:, None])
                    add(word, "b_all", _lse(flat, 0)[:, None])
                    each = np.full(logs[word][1].shape, -np.inf)
                    for k in np.unique(symbol):
                        each[:, k] = _lse(flat[symbol == k], 0)
                    add(word, "b", each)
        out = [(word, kind, i, j, float(v)) for (word, kind), values in have.items() for (i, j), v in np.ndenumerate(values) if np.isfinite(v)]
        yield pd.DataFrame(out, columns=["word", "kind", "i", "j", "v"])

    parts = sequences.select(*schema.KEY, "obs").mapInPandas(run, _LONG)
    sums = log_sum_exp_by(parts.where("kind <> 'total'"), ["word", "kind", "i", "j"], "v", "v")
    return sums.union(parts.where("kind = 'total'").groupBy("word", "kind", "i", "j").agg(F.sum("v").alias("v")))


def m_step(stats: DataFrame, symbols: int, states: int = 4) -> DataFrame:
    """(word, kind a|b|pi, i, j, p) from statistics(), before normalisation: an unseen symbol has UNSEEN, a state without mass zeros."""
    spark = stats.sparkSession
    cells = [("pi", i, 0) for i in range(states)] + [("a", i, j) for i in range(states) for j in range(states)]
    grid = spark.createDataFrame(cells, "kind string, i int, j int")
    grid = grid.union(spark.range(states * symbols).select(F.lit("b"), (F.col("id") / symbols).cast("int"), (F.col("id") % symbols).cast("int")))
    grid = stats.select("word").distinct().crossJoin(F.broadcast(grid))  # the cells of one model
    below = stats.where("kind in ('n', 'a_all', 'b_all')").select("word", F.expr("case kind when 'n' then 'pi' when 'a_all' then 'a' else 'b' end").alias("kind"), "i", F.col("v").alias("all"))
    pi = below.where("kind = 'pi'").select("word", "kind", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("i"), "all")
    below = below.where("kind <> 'pi'").union(pi)
    met = grid.join(stats, ["word", "kind", "i", "j"], "left").join(below, ["word", "kind", "i"], "left")
    p = F.when(F.col("all").isNull(), 0.0).when(F.col("v").isNotNull(), F.exp(F.col("v") - F.col("all"))).otherwise(F.when(F.col("kind") == "b", UNSEEN).otherwise(0.0))
    return met.select("word", "kind", "i", "j", p.alias("p"))


def _arrays(cells: DataFrame, symbols: int, states: int) -> dict[str, dict[str, np.ndarray]]:
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in cells.collect():
        m = out.setdefault(r["word"], {"A": np.zeros((states, states)), "B": np.zeros((states, symbols)), "Pi": np.zeros(states)})
        if r["kind"] == "pi":
            m["Pi"][r["i"]] = r["p"]
        else:
            m["A" if r["kind"] == "a" else "B"][r["i"], r["j"]] = r["p"]
    return out


def train_hmms(sequences: DataFrame, symbols: int, states: int = 4, max_iter: int = 100, eps: float = 1e-6, warm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, log of iteration, word, objective, diff, total). A word stops after the update whose objective, the log of the summed likelihoods, changed by less than eps; rows are normalised at the end."""
    spark = sequences.sparkSession
    kept = sequences.where(F.size("obs") > 0).select(*schema.KEY, "obs").persist()
    try:
        start = initial_model(kept, symbols, states, warm)
        now = {r["word"]: {c: np.array(r[c], float) for c in ("A", "B", "Pi")} for r in start.collect()}
        open_, before, log = set(now), {}, []
        for iteration in range(1, max_iter + 1):
            if not open_:
                break
            with np.errstate(divide="ignore"):
                logs = {w: tuple(np.log(now[w][c]) for c in ("A", "B", "Pi")) for w in open_}
            live = kept.where(F.col("word").isin(*open_)) if len(open_) < len(now) else kept
            stats = statistics(live, logs).persist()
            told = {(r["word"], r["kind"]): r["v"] for r in stats.where("kind in ('p', 'total')").collect()}
            now |= _arrays(m_step(stats, symbols, states), symbols, states)
            stats.unpersist()
            for word in sorted(open_):
                objective = told.get((word, "p"), float("-inf"))
                diff = abs(objective - before[word]) if word in before and np.isfinite(objective) else float("inf")
                before[word] = objective
                log.append((iteration, word, float(objective), float(diff), float(told.get((word, "total"), float("-inf")))))
                if diff < eps:
                    open_ = open_ - {word}
    finally:
        kept.unpersist()
    norm = lambda x: np.divide(x, x.sum(axis=-1, keepdims=True), out=np.zeros_like(x), where=x.sum(axis=-1, keepdims=True) > 0)
    rows = [(w, states, symbols, norm(m["A"]).tolist(), norm(m["B"]).tolist(), norm(m["Pi"]).tolist()) for w, m in sorted(now.items())]
    return spark.createDataFrame(rows, schema.MODELS), spark.createDataFrame(log, "iteration int, word string, objective double, diff double, total double")
