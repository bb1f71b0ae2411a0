"""The tree as cuts, node table, regions and one expression, against Spark ML's own."""

import random

import pytest
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.operators import regions as R
from georisk.operators import score as S
from georisk.operators import tree as T


@pytest.fixture(scope="module")
def tree_mid(labelled_mid):
    return R.train(labelled_mid)


def slots(spark, rows):
    return spark.createDataFrame(rows, "Box int, Month int, DayOfWeekNum int, DayPeriod int, label double")


def cube(spark):
    return S.cube_rows(spark, GridSpec())


def test_up_to_ten_thousand_slots_it_is_the_plain_tree(spark, labelled_small):
    assert labelled_small.count() <= 10_000
    tree, plain = R.train(labelled_small), T.train_tree(labelled_small)
    a = R.predict(tree, cube(spark)).select(*T.FEATURES, "prediction")
    b = T.predict(plain, cube(spark)).select(*T.FEATURES, "prediction")
    assert a.exceptAll(b).count() == 0 and len(tree.nodes) == plain.numNodes


def test_expression_equals_the_model_on_every_slot_and_box(spark, tree_mid):
    """Also for boxes that no slot has."""
    rows = cube(spark).unionByName(cube(spark).withColumn("Box", F.col("Box") + 500))
    binned = rows.withColumn("raw", F.col("Box")).withColumn("Box", R.box_bin(tree_mid.cuts))
    model = T.predict(tree_mid.model, binned).select(F.col("raw").alias("Box"), *T.FEATURES[1:], "prediction")
    mine = R.predict(tree_mid, rows).select(*T.FEATURES, "prediction")
    assert mine.exceptAll(model).count() == 0 and mine.count() == 2 * 336 * GridSpec().n_boxes
    plan = R.predict(tree_mid, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_regions_hold_each_slot_once(spark, tree_mid, labelled_mid):
    found = R.regions(tree_mid.nodes)
    rows = labelled_mid.select(*T.FEATURES).collect()
    predicted = {tuple(r[:4]): r.prediction for r in R.predict(tree_mid, labelled_mid).select(*T.FEATURES, "prediction").collect()}
    held = {r.id: 0 for r in found}
    for r in rows:
        mine = [g for g in found if (g.box_above is None or r.Box > g.box_above) and (g.box_upto is None or r.Box <= g.box_upto)
                and r.Month in g.Month and r.DayOfWeekNum in g.DayOfWeekNum and r.DayPeriod in g.DayPeriod]
        assert len(mine) == 1 and mine[0].level == predicted[tuple(r)]
        held[mine[0].id] += 1
    assert held == {r.id: r.slots for r in found}
    assert R.region_table(spark, found).count() == sum(n.feature is None for n in tree_mid.nodes)


def test_the_tree_does_not_depend_on_layout(labelled_mid, tree_mid):
    assert R.train(labelled_mid.repartition(3)).nodes == tree_mid.nodes


def test_cuts(spark):
    def cuts(boxes, n):
        return R.box_cuts(slots(spark, [(b, 0, 1, 0, 0.0) for b in boxes]), n)

    assert cuts([4], 3) == [] and cuts([4, 4, 7], 3) == [5.5] and cuts([1, 2, 3], 3) == [1.5, 2.5]
    # 8 rows in 3 bins: the running count is closest to 8/3 after box 2, to 16/3 after box 4
    assert cuts([1, 2, 2, 3, 4, 5, 6, 7], 3) == [2.5, 4.5]
    # a hot box takes a bin of its own
    assert cuts([1] + [2] * 50 + [3, 4, 5], 4) == [1.5, 2.5, 3.5]
    assert [r.b for r in slots(spark, [(b, 0, 1, 0, 0.0) for b in (1, 2, 3)]).orderBy("Box").select(
        R.box_bin([1.5, 2.0]).alias("b")).collect()] == [0, 1, 2]


@pytest.mark.parametrize("seed", range(4))
def test_oracle_on_random_slots(spark, seed):
    """The SQL grows the same tree on other tables: few boxes, ties, one class, no rows to part."""
    import duckdb

    from georisk import tree_sql as TS
    r = random.Random(seed)
    n_boxes, n = [(5, 60), (40, 900), (200, 3000), (3, 40)][seed]
    rows = list({(b := r.randrange(n_boxes), m := r.randrange(12), d := r.randint(1, 7), p := r.randrange(4)):
                 (b, m, d, p, float(0 if seed == 3 else min(2, (b * 7 // n_boxes + (m > 6) + (p == 2) * r.randint(0, 2)) // 3))) for _ in range(n)}.values())
    tree = R.train(T.materialize(slots(spark, rows)))
    con = duckdb.connect()
    con.execute('CREATE TABLE t (Box INTEGER, "Month" INTEGER, DayOfWeekNum INTEGER, DayPeriod INTEGER, label DOUBLE)')
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    for body, mine in ((TS.NODES, R.node_table(spark, tree.nodes)), (TS.REGIONS, R.region_table(spark, R.regions(tree.nodes)))):
        want = con.execute("WITH RECURSIVE " + TS.grown("t") + body).fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in mine.collect())
