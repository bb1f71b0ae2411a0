"""End-to-end jobs on an incident CSV export of the sf0.001 fixture."""

import datetime as dt
import os

from georisk import jobs
from georisk.sources import csv as CSV
from georisk.sources.incidents import lineitem_incident_base, read_table

from conftest import SF0001


def test_train_then_score(spark, tmp_path):
    src = str(tmp_path / "rows")
    CSV.write_csv(CSV.incidents_to_raw(lineitem_incident_base(read_table(spark, SF0001, "lineitem"))), src)
    seen = []
    res = jobs.train_job(spark, src, str(tmp_path / "model"), report=lambda t, df: seen.append((t, df.count())))
    assert ("test error", 1) in seen and res.labelled.count() == 3360
    assert ("raw, kept and rejected rows", 1) in seen and ("count by weekday name", 7) in seen
    assert ("prediction for one slot", 1) in seen and ("first slots", 5) in seen
    req = tmp_path / "req"
    req.mkdir()
    (req / "userinput.txt").write_text("2015-01-01 10:00:00\n")
    out = str(tmp_path / "useroutput")
    jobs.score_job(spark, str(tmp_path / "model"), str(req), out, now=dt.datetime(2015, 1, 1), report=None)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    with open(os.path.join(out, files[0])) as f:
        lines = f.read().splitlines()
    assert len(lines) == 166 and lines[0].startswith("0,") and lines[-1].startswith("165,")
    (req / "more.txt").write_text("2015-01-02 23:00:00\n2015-06-01 12:00:00\n")
    import pytest
    with pytest.raises(ValueError):
        jobs.score_job(spark, str(tmp_path / "model"), str(req), str(tmp_path / "x"), report=None)
    table = str(tmp_path / "scores")
    jobs.score_job(spark, str(tmp_path / "model"), str(req), table, single_file=False, report=None)
    assert spark.read.parquet(table + "/requests").count() == 3
    assert spark.read.parquet(table + "/cube").count() == 336 * 166
    assert spark.read.parquet(table + "/heatmap").count() == 3 * 166


def test_scores_of_many_requests_are_kept(spark, labelled_small, tmp_path):
    import pytest
    from georisk.operators import tree as T
    model = T.save_model(T.train_tree(labelled_small), str(tmp_path / "model"))
    req = tmp_path / "req"
    req.mkdir()
    texts = [f"2015-01-{d:02d} {h:02d}:00:00" for d in range(1, 16) for h in (3, 15)] + ["2015-01-01 10:00", "soon"]
    (req / "a.txt").write_text("\n\n".join(texts) + "\n")
    out = str(tmp_path / "out")
    jobs.score_job(spark, model, str(req), out, single_file=False, expand=True, now=dt.datetime(2015, 1, 1), report=None)
    mean = spark.read.parquet(out + "/mean_risk")
    assert sorted(r.request for r in mean.collect()) == sorted(texts)
    assert {r.request for r in mean.filter("NOT valid").collect()} == {"2015-01-01 10:00", "soon"}
    assert spark.read.parquet(out + "/scores").count() == len(texts) * 166
    with pytest.raises(Exception):
        jobs.score_job(spark, model, str(req), str(tmp_path / "strict"), single_file=False, strict=True, report=None)


def test_command_line_on_another_grid(spark, tmp_path, monkeypatch):
    import georisk.session
    monkeypatch.setattr(georisk.session, "build_session", lambda *a, **k: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    keep = {k: spark.conf.get(k) for k in georisk.session.scale_conf(1, 1)}
    src = str(tmp_path / "rows")
    CSV.write_csv(CSV.incidents_to_raw(lineitem_incident_base(read_table(spark, SF0001, "lineitem"))), src)
    grid = ["--cell", "0.02", "--max-y", "37.78"]
    try:
        jobs.main(["train", "--source", src, "--model", str(tmp_path / "m"), "--low-below", "3", "--medium-below", "9",
                   "--date-mode", "compat", *grid])
        (tmp_path / "req.txt").write_text("2015-01-01 10:00:00\n2015-02-01 23:00:00\n")
        jobs.main(["score", "--model", str(tmp_path / "m"), "--requests", str(tmp_path / "req.txt"), "--out", str(tmp_path / "o"),
                   "--table", *grid])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    spec = jobs.replace(jobs.GridSpec(), cell=0.02, max_y=37.78).full_stride()
    assert spark.read.parquet(str(tmp_path / "o") + "/cube").count() == 336 * spec.n_boxes


def test_train_from_parquet(spark, tmp_path):
    from georisk.sources import parquet as PQ
    from georisk.sources.incidents import incidents_from_tables
    src = str(tmp_path / "pq")
    PQ.write_incidents(incidents_from_tables(spark, SF0001, keep_out_of_bounds=True).drop("in_bounds"), src)
    assert len([f for d, _, fs in os.walk(src) for f in fs if f.endswith(".parquet")]) <= 7 + 8  # years and range cuts
    res = jobs.train_job(spark, src, str(tmp_path / "m"), fmt="parquet", report=None)
    assert res.labelled.count() == 3360 and res.model.numClasses == 3


def test_parquet_source_follows_the_grid_and_options(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    from georisk.functions.grid import GridSpec
    from georisk.functions.timefeatures import compat_date
    from georisk.sources import parquet as PQ
    from georisk.sources.incidents import incidents_from_tables
    src = str(tmp_path / "pq")
    rows = incidents_from_tables(spark, SF0001, keep_out_of_bounds=True).drop("in_bounds")
    PQ.write_incidents(rows, src)
    fine = GridSpec(cell=0.0025).full_stride()
    got = PQ.read_incidents(spark, src, fine, date_mode="compat")
    assert got.filter(F.col("Box") != fine.box_id("X", "Y")).count() == 0
    assert got.filter(F.col("Date") != compat_date("Timestamp")).count() == 0 and got.count() == 5705
    holes = str(tmp_path / "holes")
    PQ.write_incidents(rows.withColumn("X", F.when(F.col("Hour") == 5, None).otherwise(F.col("X"))), holes)
    kept = jobs.load_incidents(spark, holes, "parquet", lenient=True)
    assert kept.filter("Hour = 5").count() == 0 and kept.count() == got.filter("Hour <> 5").count()
    with pytest.raises(Exception, match="without coordinates"):
        jobs.load_incidents(spark, holes, "parquet").count()


def test_prefilter_on_projected_coordinates(spark, tmp_path):
    from pyspark.sql import functions as F
    from georisk.functions.grid import GridSpec
    g = GridSpec(4_000_000.1, 4_100_000.3, -7_000_000.7, 0.0, 1000.0, 101)
    edge = [4_000_000.1, 4_100_000.3, 4_000_000.0, 4_000_000.25, 3_999_999.9, 4_100_000.1, 4_100_000.5, 4_050_000.0]
    ys = [-7_000_000.7, -7_000_000.5, -7_000_001.0, -7_000_000.0, 0.0, 1e-46, 1e-44, -5.0]
    df = spark.createDataFrame([(x, y) for x in edge for y in ys], "X double, Y double")
    exact = df.filter(g.in_bounds("X", "Y"))
    assert exact.count() > 9
    assert exact.filter(g.prefilter("X", "Y")).count() == exact.count()


def test_cube_and_training_spread(spark):
    from georisk.functions.grid import GridSpec
    from georisk.operators import cells as C
    from georisk.operators import score as S
    from georisk.operators import tree as T
    fine = GridSpec(cell=0.001).full_stride()
    cube = S.cube_rows(spark, fine)
    assert cube.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert T.train_partitions(C.slot_bound(GridSpec())) == 8 < T.train_partitions(C.slot_bound(fine))
    small = S.cube_rows(spark).groupBy(*S.SLOT_KEYS).count().collect()
    assert len(small) == 336 and {r["count"] for r in small} == {166}
    assert {(r.Month, r.DayOfWeekNum, r.DayPeriod) for r in small} == {(m, d, p) for m in range(12) for d in range(1, 8) for p in range(4)}
