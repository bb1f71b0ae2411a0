"""The risk tree as a table: exact bins for Box, the node table, decision regions, and
one Catalyst expression that predicts.

Spark ML draws the 32 bins of a continuous feature from a sample once there are
more than 10,000 rows, so its tree depends on which rows were drawn. Here the cuts
come from the counts of all boxes (:func:`box_cuts`), and Spark ML trains on the
bin's number, so nothing is sampled: the tree is a function of the slot table alone.
With at most 10,000 slots the cuts, and so the tree, are those of :func:`tree.train_tree`.

A tree of depth 5 has at most 63 nodes. They are read back from the saved model, and

* :func:`node_table` lists them with split feature, Box threshold and left categories,
* :func:`regions` lists each leaf's box interval and its sets of months, weekdays and periods,
* :func:`prediction` is the tree as nested conditions, evaluated in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.risk import N_CLASSES
from georisk.operators import tree as T
from georisk.session import shared_path

#: Bins that Spark ML may use: more than the 32 a box can have, so that its sample (at least the
#: square of this) holds every slot of the default grid; fewer than 254, so that DayOfWeekNum
#: (arity 8) stays an ordered feature as with 32.
LEARNER_BINS = 250


def box_cuts(labelled: DataFrame, max_bins: int = T.MAX_BINS) -> list[float]:
    """Thresholds between boxes, at most ``max_bins - 1``: midpoints of all neighbouring boxes if
    those are few enough, else where the running count of slots comes closest to a multiple
    of ``slots / max_bins``. The counts collected are one row per box (bounded by the grid)."""
    counts = [(r.Box, r.n) for r in labelled.groupBy("Box").agg(F.count(F.lit(1)).alias("n")).orderBy("Box").collect()]
    middles = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(middles) < max_bins:
        return middles
    stride = sum(n for _, n in counts) / max_bins
    cuts, target, total = [], stride, counts[0][1]
    for middle, (_, n) in zip(middles, counts[1:]):
        before, total = total, total + n
        if abs(before - target) < abs(total - target):
            cuts.append(middle)
            target += stride
    return cuts


def box_bin(cuts: list[float]) -> Column:
    """The number of cuts below the box."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("Box"))) if cuts else F.lit(0)


@dataclass(frozen=True)
class Node:
    """``feature`` None: a leaf. Rows go left if Box <= ``threshold`` or their value is in ``categories``."""

    id: int
    prediction: int
    gain: float
    counts: tuple[int, ...]
    feature: str | None = None
    threshold: float | None = None
    categories: tuple[int, ...] | None = None
    left: int = -1
    right: int = -1


@dataclass
class BinnedTree:
    """A tree trained on box bins; ``nodes`` in order of id (parents before children)."""

    model: DecisionTreeClassificationModel
    cuts: list[float]
    nodes: list[Node]


def train(labelled: DataFrame, **kw) -> BinnedTree:
    """Train on ``labelled`` (materialized slots), and read the nodes back from the saved model."""
    spark, cuts = labelled.sparkSession, box_cuts(labelled)
    binned = labelled.withColumn("Box", box_bin(cuts))
    model = T.train_tree(binned, **({"max_bins": LEARNER_BINS} | kw))
    return BinnedTree(model, cuts, read_nodes(spark, T.save_model(model, shared_path(spark, "model")), cuts))


def read_nodes(spark: SparkSession, path: str, cuts: list[float]) -> list[Node]:
    out = []
    for r in spark.read.parquet(f"{path}/data").orderBy("id").collect():  # at most 2 ** (depth + 1) - 1 rows
        node = dict(id=r.id, prediction=int(r.prediction), gain=r.gain, counts=tuple(int(x) for x in r.impurityStats))
        if r.leftChild >= 0:
            values, name = r.split.leftCategoriesOrThreshold, T.FEATURES[r.split.featureIndex]
            node |= dict(feature=name, left=r.leftChild, right=r.rightChild)
            if name in T.CATEGORICAL_ARITY:
                node["categories"] = tuple(int(v) for v in values)
            else:  # between two bin numbers: the cut that parts them
                node["threshold"] = cuts[int(values[0])]
        out.append(Node(**node))
    return out


def node_table(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    schema = ("id int, prediction int, gain double, leftChild int, rightChild int, feature string, threshold double, "
              "categories string, " + ", ".join(f"class_{c} bigint" for c in range(N_CLASSES)))
    return spark.createDataFrame([(
        n.id, n.prediction, n.gain, n.left, n.right, n.feature, n.threshold,
        None if n.categories is None else ",".join(map(str, n.categories)), *n.counts) for n in nodes], schema)


def _goes_left(node: Node) -> Column:
    c = F.col(node.feature)
    return c <= F.lit(node.threshold) if node.categories is None else c.isin(*node.categories)


def prediction(nodes: list[Node], at: int = 0) -> Column:
    """The predicted level as nested conditions, as deep as the tree."""
    by_id = {n.id: n for n in nodes}
    node = by_id[at]
    if node.feature is None:
        return F.lit(node.prediction)
    return F.when(_goes_left(node), prediction(nodes, node.left)).otherwise(prediction(nodes, node.right))


def predict(tree: BinnedTree, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (double, as Spark ML's) for rows with the four feature columns."""
    return df.withColumn("prediction", prediction(tree.nodes).cast("double"))


@dataclass(frozen=True)
class Region:
    """The slots of one leaf: boxes above ``box_above`` (if any) up to ``box_upto``, and sets of values."""

    id: int
    level: int
    slots: int
    box_above: float | None
    box_upto: float | None
    Month: tuple[int, ...]
    DayOfWeekNum: tuple[int, ...]
    DayPeriod: tuple[int, ...]


def regions(nodes: list[Node]) -> list[Region]:
    """Every leaf's region; together they hold each combination of values exactly once."""
    by_id, out = {n.id: n for n in nodes}, []

    def walk(at: int, low: float | None, high: float | None, sets: dict[str, tuple[int, ...]]) -> None:
        node = by_id[at]
        if node.feature is None:
            out.append(Region(node.id, node.prediction, sum(node.counts), low, high, **sets))
        elif node.categories is None:
            walk(node.left, low, node.threshold, sets)
            walk(node.right, node.threshold, high, sets)
        else:
            kept = sets[node.feature]
            walk(node.left, low, high, sets | {node.feature: tuple(v for v in kept if v in node.categories)})
            walk(node.right, low, high, sets | {node.feature: tuple(v for v in kept if v not in node.categories)})

    walk(0, None, None, {name: tuple(range(arity)) for name, arity in T.CATEGORICAL_ARITY.items()})
    return out


def region_table(spark: SparkSession, found: list[Region]) -> DataFrame:
    sets = list(T.CATEGORICAL_ARITY)
    schema = "id int, level int, slots bigint, box_above double, box_upto double, " + ", ".join(f"{c} string" for c in sets)
    return spark.createDataFrame([(r.id, r.level, r.slots, r.box_above, r.box_upto, *[
        ",".join(map(str, getattr(r, c))) for c in sets]) for r in found], schema)
