"""Decision-tree risk model on labelled slots (Spark ML).

Training input is the labelled slot table, whose size is bounded by the grid
(:func:`georisk.operators.cells.slot_bound`), so training cost does not grow
with the incident volume. It is cut from its lineage (:func:`materialize`)
before the tree's repeated passes, so no pass and no executor loss re-runs the
incident scan.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.risk import N_CLASSES
from georisk.session import shared_root

# Fixed values that must equal the reference: features in this order, categorical
# arities Month 12, DayOfWeekNum 8, DayPeriod 4 (Box numeric), gini impurity,
# maximum depth 5, 32 bins.
FEATURES = ["Box", "Month", "DayOfWeekNum", "DayPeriod"]
CATEGORICAL_ARITY = {"Month": 12, "DayOfWeekNum": 8, "DayPeriod": 4}
IMPURITY = "gini"
MAX_DEPTH = 5
MAX_BINS = 32
# Seed of the split-candidate sample (the RDD-based API uses 0) and the fixed
# layout of the training input, so the tree does not depend on cluster size,
# shuffle settings or AQE: the learner samples rows per partition when there are
# more than 10,000 of them.
SEED = 0
TRAIN_PARTITIONS = 8
SLOTS_PER_TASK = 500_000


def train_partitions(slots: int) -> int:
    """Training tasks for a bound on the number of slots (of the grid, not of the
    cluster, so that the layout and the tree stay the same everywhere)."""
    return max(TRAIN_PARTITIONS, -(-slots // SLOTS_PER_TASK))


def features_metadata() -> dict:
    numeric, nominal = [], []
    for i, name in enumerate(FEATURES):
        if name in CATEGORICAL_ARITY:
            nominal.append({"idx": i, "name": name, "num_vals": CATEGORICAL_ARITY[name]})
        else:
            numeric.append({"idx": i, "name": name})
    return {"ml_attr": {"attrs": {"numeric": numeric, "nominal": nominal}, "num_attrs": len(FEATURES)}}


def label_metadata(n_classes: int = N_CLASSES) -> dict:
    return {"ml_attr": {"type": "nominal", "num_vals": n_classes}}


def assemble(df: DataFrame, label_col: str | None = "label") -> DataFrame:
    """Add ``features`` (dense vector of FEATURES as doubles) with the categorical
    metadata, and mark the label as a fixed 3-class nominal column so the class
    count never depends on which labels happen to occur."""
    out = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    out = out.withMetadata("features", features_metadata())
    if label_col and label_col in out.columns:
        out = out.withMetadata(label_col, label_metadata())
    return out


def feature_columns(assembled: DataFrame) -> DataFrame:
    """The vector unpacked back to scalar columns (for checks against SQL)."""
    arr = vector_to_array(F.col("features"))
    return assembled.select(*[c for c in assembled.columns if c != "features"],
                            *[arr[i].alias(f"f_{n}") for i, n in enumerate(FEATURES)])


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def classifier(max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS, impurity: str = IMPURITY,
               seed: int = SEED) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol="label", predictionCol="prediction",
                                  maxDepth=max_depth, maxBins=max_bins, impurity=impurity, seed=seed)


def training_input(labelled: DataFrame, partitions: int = TRAIN_PARTITIONS) -> DataFrame:
    """Labelled slots in a layout fixed by their keys alone (hash partitions, sorted
    within each). The table is bounded by the grid, so this shuffle is small."""
    return labelled.repartition(partitions, *FEATURES).sortWithinPartitions(*FEATURES)


def train_tree(labelled: DataFrame, partitions: int = TRAIN_PARTITIONS, **kw) -> DecisionTreeClassificationModel:
    return classifier(**kw).fit(assemble(training_input(labelled, partitions)))


def predict(model: DecisionTreeClassificationModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (double) for rows carrying the four feature columns."""
    keep = [c for c in df.columns]
    scored = model.transform(assemble(df, label_col=None))
    return scored.select(*keep, "prediction")


def predict_vector(model: DecisionTreeClassificationModel, values: list[float]) -> float:
    return float(model.predict(Vectors.dense(values)))


def saved_nodes(spark: SparkSession, path: str, n_classes: int = N_CLASSES) -> DataFrame:
    """The node table of a saved tree: id, prediction, children, gain and class counts."""
    return spark.read.parquet(f"{path}/data").select("id", "prediction", "leftChild", "rightChild", "gain", *[
        F.get("impurityStats", i).cast("bigint").alias(f"class_{i}") for i in range(n_classes)])


def save_model(model: DecisionTreeClassificationModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> DecisionTreeClassificationModel:
    return DecisionTreeClassificationModel.load(path)
