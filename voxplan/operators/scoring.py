"""Recognition and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxplan.functions.logmath import NEVER
from voxplan.operators.hmm import forward_loglik, forward_loglik_blocks

UNKNOWN = "unknown"


def trained_only(test: DataFrame, models: DataFrame) -> DataFrame:
    """Recordings whose word has a model."""
    return test.join(models.select("word"), "word", "left_semi")


def score_all(sequences: DataFrame, models: DataFrame) -> DataFrame:
    """(word, recording, model_word, loglik): every recording under every model."""
    return forward_loglik(sequences, models)


def predict(scores: DataFrame) -> DataFrame:
    """(word, recording, predicted, loglik): the likeliest model, the first by word of equally likely ones; unknown if all are impossible."""
    best = F.min(F.struct((-F.col("loglik")).alias("cost"), "model_word"))
    out = scores.groupBy("word", "recording").agg(best.alias("b"))
    return out.select("word", "recording", F.when(F.col("b.cost") == -NEVER, UNKNOWN).otherwise(F.col("b.model_word")).alias("predicted"), (-F.col("b.cost")).alias("loglik"))


def predict_sequences(sequences: DataFrame, models: DataFrame) -> DataFrame:
    """As predict(score_all(...)): the task that scores a recording has all models and picks the likeliest, so nothing is shuffled."""
    best = forward_loglik(sequences, models, best=True)
    return best.select("word", "recording", F.when(F.col("loglik") == NEVER, UNKNOWN).otherwise(F.col("model_word")).alias("predicted"), "loglik")


def score_blocks(sequences: DataFrame, models: DataFrame, block: int = 256) -> DataFrame:
    """As score_all, for thousands of models, of which a task has some."""
    return forward_loglik_blocks(sequences, models, block=block)


def predict_blocks(sequences: DataFrame, models: DataFrame, block: int = 256) -> DataFrame:
    """As predict_sequences, for thousands of models: each block's winners are merged."""
    best = forward_loglik_blocks(sequences, models, True, block)
    return best.select("word", "recording", F.when(F.col("loglik") == NEVER, UNKNOWN).otherwise(F.col("model_word")).alias("predicted"), "loglik")


def rank_models(scores: DataFrame) -> DataFrame:
    """scores with rank, from 1, by falling likelihood and then word."""
    order = W.partitionBy("word", "recording").orderBy(F.desc("loglik"), "model_word")
    return scores.withColumn("rank", F.row_number().over(order))


def confusion_matrix(predictions: DataFrame, true: str = "word", predicted: str = "predicted") -> DataFrame:
    """(true, predicted, n, accuracy) for all pairs of labels, 0 where there are none; accuracy in percent on every row."""
    counts = predictions.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("true").alias("label")).union(counts.select("predicted")).distinct()
    total = counts.agg((F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("accuracy"))
    grid = labels.select(F.col("label").alias("true")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(counts, ["true", "predicted"], "left").crossJoin(F.broadcast(total)).select("true", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy")


def confusion_dense(predictions: DataFrame, labels: list[str], true: str = "word", predicted: str = "predicted") -> DataFrame:
    """A row for each of a fixed list of labels, in their order, with a column of counts for each of them, `unlisted` for predictions outside it, and the row's share of hits in percent (null without rows)."""
    said = F.when(F.col(predicted).isin(labels), F.col(predicted)).otherwise("unlisted")
    counts = predictions.where(F.col(true).isin(labels)).select(F.col(true).alias("true"), said.alias("said")).groupBy("true").pivot("said", [*labels, "unlisted"]).agg(F.count(F.lit(1)))
    order = predictions.sparkSession.createDataFrame(list(enumerate(labels)), "place int, true string")
    names = [*labels, "unlisted"]
    rows = F.broadcast(order).join(counts, "true", "left").select("place", "true", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in names))
    hits = F.coalesce(*(F.when(F.col("true") == c, F.col(f"`{c}`")) for c in labels))
    return rows.withColumn("hits", hits / F.nullif(sum((F.col(f"`{c}`") for c in names), F.lit(0)), F.lit(0)) * 100)


def classification_report(predictions: DataFrame, true: str = "word", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) for each label, then accuracy, macro avg and weighted avg; 0 / 0 is 0."""
    cells = confusion_matrix(predictions, true, predicted)
    each = cells.select(F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    each = each.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "said", "hit")))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    each = each.select("label", "support", "hit", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    n = F.sum("support")
    sums = each.agg(n.alias("n"), (F.sum("hit") / n).alias("accuracy"), *(F.avg(c).alias(f"m_{c}") for c in names), *((F.sum(F.col(c) * F.col("support")) / n).alias(f"w_{c}") for c in names))
    rows = [F.struct(F.lit("accuracy").alias("label"), *(F.col("accuracy").alias(c) for c in names), F.col("n").alias("support"))]
    rows += [F.struct(F.lit(label).alias("label"), *(F.col(f"{p}_{c}").alias(c) for c in names), F.col("n").alias("support")) for label, p in (("macro avg", "m"), ("weighted avg", "w"))]
    return each.select("label", *names, "support").union(sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
