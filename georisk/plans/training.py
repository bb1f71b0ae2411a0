"""Training flow: incidents → slot counts → labels → tree (all slots) and a
70/30 evaluation tree, with metrics.

One shuffle for the slot counts; the labelled slots (bounded by the grid) are
checkpointed once into the shared checkpoint folder and every later pass
(two fits, the split, the evaluation) reads that small table instead of
re-scanning the incidents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame

from georisk.functions.grid import GridSpec
from georisk.operators import cells as C
from georisk.operators import evaluate as E
from georisk.operators import tree as T


@dataclass
class TrainingResult:
    labelled: DataFrame
    model: DecisionTreeClassificationModel
    eval_model: DecisionTreeClassificationModel
    predictions: DataFrame  # test slots with label and prediction

    def confusion(self) -> DataFrame:
        return E.confusion_matrix(self.predictions)

    def error(self) -> DataFrame:
        return E.test_error(self.predictions)

    def per_class(self) -> DataFrame:
        return E.precision_recall(self.predictions)

    def macro(self) -> DataFrame:
        return E.macro_metrics(self.predictions)


def labelled_slots(incidents: DataFrame, low_below: int = 5, medium_below: int = 30) -> DataFrame:
    return T.materialize(C.label_cells(C.box_agg(incidents), low_below, medium_below))


def train(incidents: DataFrame, split_mode: str = "hash", model_path: str | None = None,
          **tree_kw) -> TrainingResult:
    return train_labelled(labelled_slots(incidents), split_mode, model_path, **tree_kw)


def train_labelled(labelled: DataFrame, split_mode: str = "hash", model_path: str | None = None,
                   grid: GridSpec = GridSpec(), **tree_kw) -> TrainingResult:
    """Training and evaluation from already materialized labelled slots of ``grid``."""
    tree_kw.setdefault("partitions", T.train_partitions(C.slot_bound(grid)))
    model = T.train_tree(labelled, **tree_kw)
    if model_path:
        T.save_model(model, model_path)
    tr, te = C.split_cells(labelled, split_mode)
    eval_model = T.train_tree(tr, **tree_kw)
    preds = T.predict(eval_model, te)
    return TrainingResult(labelled, model, eval_model, preds)
