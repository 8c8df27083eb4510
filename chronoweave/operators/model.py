"""Direction model without future leakage: split, cross-validation, fit, scores, back-test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ordered import dense_index, running_sums, time_bucket
from chronoweave.operators import boosting
from chronoweave.operators.features import FEATURES, latest_rows
from chronoweave.session import cut_lineage

MIN_ROWS = 120
BUY_THRESHOLD = 0.55


def chronological(rows: DataFrame, *, entity: str, time: str) -> DataFrame:
    """Position and row count per entity, counted in blocks, so a series of any length will do."""
    placed = dense_index(rows, [entity], [F.col(time)], time_bucket(rows, time), "_pos")
    sizes = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, entity)


def holdout_split(rows: DataFrame, *, entity: str, time: str, test_size: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the last part of every entity's series. Entities with too few
    rows are an error, because a model on them would be noise."""
    placed = chronological(rows, entity=entity, time=time)
    enough = F.when(F.col("_n") < MIN_ROWS, F.raise_error(F.lit(f"fewer than {MIN_ROWS} rows for an entity")).cast("int")).otherwise(
        F.floor(F.col("_n") * F.lit(1.0 - test_size))
    )
    return placed.withColumn("is_test", F.col("_pos") >= enough).drop("_pos", "_n")


def fold_bounds(size: Column, fold: int | Column, folds: int = 5) -> tuple[Column, Column]:
    """First and end position of the validation part of fold ``1..folds``; everything
    before it trains. The remainder of the division belongs to the first training part."""
    part = F.floor(size / (folds + 1))
    start = size - part * (folds - fold + 1)
    return start, start + part


def fold_parts(split: DataFrame, *, entity: str, time: str, folds: int = 5) -> DataFrame:
    """Per entity and fold: bounds as positions, rows before them, and rows, up moves and times between them. Folds
    ``1..folds`` divide the training part of ``holdout_split``; fold 0 is its hold-out part."""
    train = chronological(split.filter(~F.col("is_test")), entity=entity, time=time)
    every = chronological(split, entity=entity, time=time)
    start, end = fold_bounds(F.col("_n"), F.col("fold"), folds)
    inner = train.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumns({"start_row": start, "end_row": end})
    kept = split.groupBy(entity).agg(F.count_if(~F.col("is_test")).alias("start_row"))
    outer = every.join(kept, entity).withColumns({"fold": F.lit(0), "end_row": F.col("_n").cast("long")}).select(*inner.columns)
    valid = (F.col("_pos") >= F.col("start_row")) & (F.col("_pos") < F.col("end_row"))
    return outer.unionByName(inner).groupBy(entity, "fold", "start_row", "end_row").agg(
        F.count_if(F.col("_pos") < F.col("start_row")).alias("train_rows"), F.count_if(valid).alias("valid_rows"),
        F.count_if(valid & (F.col("target") == 1)).alias("valid_up"),
        F.min(F.when(valid, F.col(time))).alias("valid_start"), F.max(F.when(valid, F.col(time))).alias("valid_end"),
    )


def score(model: boosting.Boosted, rows: DataFrame) -> DataFrame:
    """Probability of an up move and the prediction at one half."""
    return boosting.with_probability(rows, model).withColumn("prediction", (F.col("prob_up") >= 0.5).cast("double"))


@dataclass
class Scores:
    accuracy: float
    roc_auc: float | None
    by_class: DataFrame


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from one confusion table."""
    cells = scored.select(F.col("target").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).groupBy("y", "p").count()
    labels = F.array(F.lit(0), F.lit(1))
    rows = cells.select("y", "p", "count", F.explode(labels).alias("class")).groupBy("class").agg(
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("p") == F.col("class")), F.col("count")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("count")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("y") == F.col("class"), F.col("count")).otherwise(0)).alias("support"),
    )
    precision = F.col("hit") / F.nullif(F.col("said"), F.lit(0))
    recall = F.col("hit") / F.nullif(F.col("support"), F.lit(0))
    return rows.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"), "support",
    )


def evaluate(scored: DataFrame) -> Scores:
    labelled = scored.withColumn("target", F.col("target").cast("double"))
    accuracy = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(labelled)
    one_class = labelled.select("target").distinct().limit(2).count() < 2
    auc = None if one_class else BinaryClassificationEvaluator(
        labelCol="target", rawPredictionCol="prob_up", metricName="areaUnderROC").evaluate(labelled)
    return Scores(accuracy, auc, class_report(labelled))


def fold_accuracies(placed: DataFrame, models: list[boosting.Boosted]) -> list[float]:
    """Accuracy of each fold's model on the fold's validation part; ``placed`` has ``_pos`` and ``_train``."""
    accuracies = []
    for fold, model in enumerate(models, 1):
        start, end = fold_bounds(F.col("_train"), fold, len(models))
        scored = score(model, placed.filter(~F.col("is_test") & (F.col("_pos") >= start) & (F.col("_pos") < end)))
        accuracies.append(scored.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0])
    return accuracies


def strategy_returns(scored: DataFrame, *, threshold: float = BUY_THRESHOLD) -> DataFrame:
    """Return earned when long only on confident up moves."""
    long = F.col("prob_up") >= threshold
    return scored.withColumn("strategy_return", F.when(long, F.col("future_return")).otherwise(F.lit(0.0)))


def growth_logs(returns: DataFrame, value: str, *, entity: str, time: str, name: str) -> DataFrame:
    """Growth of 1.0 along the series as ``log_<name>``, the logarithm of its size, and ``<name>_sign``.

    A missing return counts as zero. The sign is 0 from a total loss (a return of -1) on, and
    turns with every return below -1; on the log scale no curve is too steep for a double.
    """
    factor = 1 + F.coalesce(value, F.lit(0.0))
    sums = running_sums(returns, [entity], [F.col(time)], time_bucket(returns, time), {
        f"log_{name}": F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0),
        "_lost": F.when(factor == 0, 1).otherwise(0), "_flips": F.when(factor < 0, 1).otherwise(0)})
    sign = F.when(F.col("_lost") > 0, 0).when(F.col("_flips") % 2 == 1, -1).otherwise(1)
    return sums.withColumn(f"{name}_sign", sign).drop("_lost", "_flips")


def growth_curve(returns: DataFrame, value: str, *, entity: str, time: str, name: str) -> DataFrame:
    """Growth of 1.0 along the series, from ``growth_logs``."""
    logs = growth_logs(returns, value, entity=entity, time=time, name=name)
    return logs.withColumn(name, F.col(f"{name}_sign") * F.exp(f"log_{name}")).drop(f"log_{name}", f"{name}_sign")


def train_direction_model(rows: DataFrame, *, entity: str, time: str, test_size: float = 0.2, rounds: int = 200,
                          folds: int = 5, step: float = 0.04) -> tuple[boosting.Boosted, DataFrame, Scores, list[float]]:
    """Hold-out split, fit, scored hold-out rows, and accuracies of an expanding-window cross-validation.

    The model of the training part and those of the folds, which each train on rows before their validation part only, grow
    together in the same passes over the rows.
    """
    split = holdout_split(rows, entity=entity, time=time, test_size=test_size)
    sizes = split.groupBy(entity).agg(F.count_if(~F.col("is_test")).alias("_train"))
    placed = cut_lineage(chronological(split, entity=entity, time=time).join(sizes, entity))
    train = ~F.col("is_test")
    parts = [train, *[train & (F.col("_pos") < fold_bounds(F.col("_train"), fold, folds)[0]) for fold in range(1, folds + 1)]]
    model, *by_fold = boosting.boosted(placed, FEATURES, F.col("target"), parts, rounds=rounds, step=step)
    scored = strategy_returns(score(model, placed.filter("is_test").drop("_pos", "_n", "_train")))
    return model, scored, evaluate(scored), fold_accuracies(placed, by_fold)


def score_latest(model: boosting.Boosted, features: DataFrame, *, entity: str, time: str) -> DataFrame:
    """Probability of an up move for the newest bar of every entity."""
    return score(model, latest_rows(features, entity=entity, time=time))
