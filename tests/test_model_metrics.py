"""Tree invariants, model persistence, and metric identities against brute force."""

import math

import pytest

from georisk.operators import cells as C
from georisk.operators import evaluate as E
from georisk.operators import tree as T
from georisk.plans import training


@pytest.fixture(scope="module")
def model_mid(labelled_mid):
    return T.train_tree(labelled_mid)


def test_tree_shape_and_classes(model_mid, labelled_mid):
    assert model_mid.depth <= 5
    assert model_mid.numClasses == 3
    preds = {r.prediction for r in T.predict(model_mid, labelled_mid).select("prediction").distinct().collect()}
    assert preds <= {0.0, 1.0, 2.0}
    # nominal metadata makes the splits category sets, not thresholds
    assert " in {" in model_mid.toDebugString


def test_three_classes_even_without_high_cells(labelled_small):
    assert labelled_small.filter("label = 2").count() == 0
    assert T.train_tree(labelled_small).numClasses == 3


def test_matches_rdd_api_tree(spark, labelled_mid, model_mid):
    from pyspark.mllib.regression import LabeledPoint
    from pyspark.mllib.tree import DecisionTree
    rows = labelled_mid.select("label", *T.FEATURES).collect()
    # same rows in the same partition layout as the DataFrame learner sees them
    rdd = T.training_input(labelled_mid).select("label", *T.FEATURES).rdd.map(
        lambda r: LabeledPoint(r[0], [float(v) for v in r[1:]]))
    old = DecisionTree.trainClassifier(rdd, numClasses=3, categoricalFeaturesInfo={1: 12, 2: 8, 3: 4},
                                       impurity="gini", maxDepth=5, maxBins=32)
    # the DataFrame learner merges sibling leaves that predict the same class, so node
    # counts differ (old API keeps them); the prediction function must be identical
    assert old.depth() == model_mid.depth and old.numNodes() >= model_mid.numNodes
    mine = {tuple(float(v) for v in r[:4]): r.prediction
            for r in T.predict(model_mid, labelled_mid).select(*T.FEATURES, "prediction").collect()}
    feats = rdd.map(lambda lp: lp.features)
    theirs = list(zip(feats.collect(), old.predict(feats).collect()))
    assert len(theirs) == len(rows) == len(mine)
    assert all(mine[tuple(f.toArray().tolist())] == p for f, p in theirs)


def test_training_is_layout_independent(labelled_mid, model_mid):
    other = T.train_tree(labelled_mid.repartition(5))
    a = T.predict(model_mid, labelled_mid).select(*T.FEATURES, "prediction")
    b = T.predict(other, labelled_mid).select(*T.FEATURES, "prediction")
    assert a.exceptAll(b).count() == 0


def test_save_load_same_predictions(spark, model_mid, labelled_mid, tmp_path):
    path = T.save_model(model_mid, str(tmp_path / "model"))
    loaded = T.load_model(path)
    a = T.predict(model_mid, labelled_mid).select(*T.FEATURES, "prediction")
    b = T.predict(loaded, labelled_mid).select(*T.FEATURES, "prediction")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert T.predict_vector(loaded, [72, 8, 2, 1]) == T.predict_vector(model_mid, [72, 8, 2, 1])


def test_training_flow_beats_majority_class(spark):
    from georisk.sources.incidents import incidents_from_tables
    res = training.train(incidents_from_tables(spark, "/root/testdata/sf0.01"))
    err = res.error().first()
    counts = {r.label: r.n for r in C.label_counts(res.predictions).collect()}
    majority_err = 1 - max(counts.values()) / sum(counts.values())
    assert err.test_error < majority_err
    conf = res.confusion().collect()
    assert len(conf) == 9 and sum(r.n for r in conf) == err.n_test
    trace = sum(r.n for r in conf if r.label == r.prediction)
    assert math.isclose(err.test_error, 1 - trace / err.n_test)


def brute(pairs):
    out = {}
    for c in range(3):
        tp = sum(1 for l, p in pairs if l == c and p == c)
        pr = sum(1 for l, p in pairs if p == c)
        ac = sum(1 for l, p in pairs if l == c)
        out[c] = (tp / pr if pr else float("nan"), tp / ac if ac else float("nan"))
    return out


def test_metrics_against_brute_force_with_nan(spark):
    pairs = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(2.0, 1.0)] * 4  # class 2 never predicted
    df = spark.createDataFrame(pairs, "label double, prediction double")
    want = brute(pairs)
    got = {r["class"]: (r.precision, r.recall) for r in E.precision_recall(df).collect()}
    for c in range(3):
        for a, b in zip(got[c], want[c]):
            assert (math.isnan(a) and math.isnan(b)) or math.isclose(a, b)
    macro = E.macro_metrics(df).first()
    assert math.isnan(macro.macro_precision)  # a NaN class poisons the macro average, as in the reference
    assert math.isclose(macro.macro_recall, sum(w[1] for w in want.values()) / 3)
    summ = E.metrics_summary(df).first()
    assert (summ.n_wrong, summ.n_test) == (6, 14) and math.isclose(summ.test_error, 6 / 14)
    cm = {(r.label, r.prediction): r.n for r in E.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(2.0, 2.0)] == 0 and cm[(2.0, 1.0)] == 4


def test_baseline_predictor_matches_brute_force(spark, labelled_mid):
    split = C.mark_split(labelled_mid)
    rows = split.select("Box", "Count", "split").collect()
    per_box = {}
    for r in rows:
        if r.split == "train":
            s, n = per_box.get(r.Box, (0, 0))
            per_box[r.Box] = (s + r.Count, n + 1)

    def level(box):
        if box not in per_box:
            return 0.0
        m = per_box[box][0] / per_box[box][1]
        return 0.0 if m < 5 else 1.0 if m < 30 else 2.0

    got = E.baseline_predictions(split).select("Box", "prediction").collect()
    assert len(got) == sum(1 for r in rows if r.split == "test")
    assert all(r.prediction == level(r.Box) for r in got)


def test_published_labelled_points(spark):
    rows = [(28, 72, 8, 2, 1), (30, 38, 1, 7, 1), (53, 111, 2, 6, 0), (19, 78, 9, 5, 3), (10, 79, 3, 4, 1)]
    cells = spark.createDataFrame(rows, "Count long, Box int, Month int, DayOfWeekNum int, DayPeriod int")
    got = [(r.label, r.features.toArray().tolist()) for r in T.assemble(C.label_cells(cells)).collect()]
    assert got == [(1.0, [72.0, 8.0, 2.0, 1.0]), (2.0, [38.0, 1.0, 7.0, 1.0]), (2.0, [111.0, 2.0, 6.0, 0.0]),
                   (1.0, [78.0, 9.0, 5.0, 3.0]), (1.0, [79.0, 3.0, 4.0, 1.0])]
    meta = T.assemble(C.label_cells(cells)).schema["features"].metadata["ml_attr"]["attrs"]
    assert {a["name"]: a["num_vals"] for a in meta["nominal"]} == {"Month": 12, "DayOfWeekNum": 8, "DayPeriod": 4}


def test_tree_queries_return_the_tree_and_its_levels(spark, labelled_small):
    from georisk.queries import ORACLES, QUERIES
    model = T.train_tree(labelled_small)
    nodes = QUERIES["train_tree"](spark, "/root/testdata/sf0.001").collect()
    assert len(nodes) == model.numNodes and {"id", "prediction", "leftChild", "rightChild", "class_0"} <= set(nodes[0].asDict())
    one = QUERIES["predict_one"](spark, "/root/testdata/sf0.001").collect()
    assert [r.prediction for r in one] == [T.predict_vector(model, [72, 8, 2, 1])]
    slot = QUERIES["score_reference_slot"](spark, "/root/testdata/sf0.001").collect()
    assert [r.pred for r in slot] == [T.predict_vector(model, [r.Box, 8, 2, 1]) for r in slot]
    assert {"train_tree", "predict_one", "score_reference_slot", "evaluate_tree", "score_all_boxes", "tree_regions"} <= set(ORACLES)
