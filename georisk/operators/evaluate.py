"""Classification metrics from one aggregation.

The reference issues one counting job per (label, prediction) pair; here the
n x n confusion counts come from a single ``agg`` of ``count_if`` columns
(partial aggregation in every task, one tiny final task), and error,
precision, recall and their macro averages are column arithmetic on that one
row. Empty confusion cells are present as zeros without any join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from georisk.functions.risk import N_CLASSES, risk_level, safe_ratio


def _cell(i: int, j: int) -> str:
    return f"c_{i}_{j}"


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     n_classes: int = N_CLASSES) -> DataFrame:
    """One row: c_i_j = #(label == i and prediction == j)."""
    l, p = F.col(label), F.col(prediction)
    return pred.agg(*[F.count_if((l == i) & (p == j)).alias(_cell(i, j))
                      for i in range(n_classes) for j in range(n_classes)])


def confusion_matrix(pred: DataFrame, n_classes: int = N_CLASSES, **kw) -> DataFrame:
    row = confusion_counts(pred, n_classes=n_classes, **kw)
    entries = ", ".join(f"CAST({i} AS DOUBLE), CAST({j} AS DOUBLE), {_cell(i, j)}"
                        for i in range(n_classes) for j in range(n_classes))
    return row.selectExpr(f"stack({n_classes * n_classes}, {entries}) AS (label, prediction, n)")


def _sum(cols: list[F.Column]) -> F.Column:
    return reduce(lambda a, b: a + b, cols)


def _per_class(n_classes: int):
    c = lambda i, j: F.col(_cell(i, j))
    tp = [c(i, i) for i in range(n_classes)]
    predicted = [_sum([c(j, i) for j in range(n_classes)]) for i in range(n_classes)]
    actual = [_sum([c(i, j) for j in range(n_classes)]) for i in range(n_classes)]
    return tp, predicted, actual


def test_error(pred: DataFrame, n_classes: int = N_CLASSES, **kw) -> DataFrame:
    row = confusion_counts(pred, n_classes=n_classes, **kw)
    tp, _, actual = _per_class(n_classes)
    total = _sum(actual)
    wrong = total - _sum(tp)
    return row.select(wrong.alias("n_wrong"), total.alias("n_test"),
                      safe_ratio(wrong, total).alias("test_error"))


def precision_recall(pred: DataFrame, n_classes: int = N_CLASSES, **kw) -> DataFrame:
    """Per class: tp / predicted (precision) and tp / actual (recall); 0/0 is NaN."""
    row = confusion_counts(pred, n_classes=n_classes, **kw)
    tp, predicted, actual = _per_class(n_classes)
    per = row.select(*[F.struct(F.lit(i).alias("class"), tp[i].alias("tp"), predicted[i].alias("predicted"),
                                actual[i].alias("actual")).alias(f"k{i}") for i in range(n_classes)])
    rows = per.select(F.explode(F.array(*[F.col(f"k{i}") for i in range(n_classes)])).alias("k")).select("k.*")
    return rows.select("class", "tp", "predicted", "actual",
                       safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                       safe_ratio(F.col("tp"), F.col("actual")).alias("recall"))


def macro_metrics(pred: DataFrame, n_classes: int = N_CLASSES, **kw) -> DataFrame:
    """Sum of per-class precision (recall) / n_classes, summed in class order;
    a NaN class makes the average NaN, as in the reference."""
    row = confusion_counts(pred, n_classes=n_classes, **kw)
    tp, predicted, actual = _per_class(n_classes)
    p = _sum([safe_ratio(tp[i], predicted[i]) for i in range(n_classes)]) / F.lit(float(n_classes))
    r = _sum([safe_ratio(tp[i], actual[i]) for i in range(n_classes)]) / F.lit(float(n_classes))
    return row.select(p.alias("macro_precision"), r.alias("macro_recall"))


def metrics_summary(pred: DataFrame, n_classes: int = N_CLASSES, **kw) -> DataFrame:
    """Error and macro precision / recall in one row, from one aggregation."""
    row = confusion_counts(pred, n_classes=n_classes, **kw)
    tp, predicted, actual = _per_class(n_classes)
    total = _sum(actual)
    wrong = total - _sum(tp)
    k = F.lit(float(n_classes))
    return row.select(wrong.alias("n_wrong"), total.alias("n_test"), safe_ratio(wrong, total).alias("test_error"),
                      (_sum([safe_ratio(tp[i], predicted[i]) for i in range(n_classes)]) / k).alias("macro_precision"),
                      (_sum([safe_ratio(tp[i], actual[i]) for i in range(n_classes)]) / k).alias("macro_recall"))


def baseline_predictions(split_cells: DataFrame) -> DataFrame:
    """A SQL-expressible reference predictor for exact metric checks.

    Every test slot gets the risk level of its box's mean count over the
    training slots (0 when the box has no training slot). ``split_cells`` is
    the labelled slot table with a ``split`` column: one window per box
    (at most 336 slots each, so no box can be hot) reads it once; nothing is
    joined and the train/test filter cannot be pushed back into the scan.
    """
    w = Window.partitionBy("Box")
    is_train = F.col("split") == F.lit("train")
    total = F.sum(F.when(is_train, F.col("Count"))).over(w)
    n = F.count(F.when(is_train, F.lit(1))).over(w)
    level = F.when(n > 0, risk_level(F.try_divide(total, n))).otherwise(F.lit(0)).cast("double")
    cols = [c for c in split_cells.columns if c != "split"]
    return (split_cells.withColumn("prediction", level).filter(~is_train)
            .select(*cols, "prediction"))
