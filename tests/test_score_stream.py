"""Scoring, mean risk, heat-map layout and the streaming scorer."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.operators import heatmap as H
from georisk.operators import score as S
from georisk.operators import tree as T
from georisk.plans import scoring
from georisk.streaming import requests as ST

NOW = dt.datetime(2015, 1, 1, 10, 0)


def test_request_features_valid_and_default(spark):
    req = spark.createDataFrame([("2015-01-01 10:00:00",), ("not a date",), ("2015-05-29 23:40:00",)], "request string")
    got = S.request_features(req, now=dt.datetime(2016, 7, 4, 19, 30)).collect()
    assert (got[0].valid, got[0].Month, got[0].DayOfWeekNum, got[0].DayPeriod) == (True, 0, 4, 1)
    assert (got[1].valid, got[1].request_ts) == (False, dt.datetime(2016, 7, 4, 19, 30))
    assert (got[1].Month, got[1].DayOfWeekNum, got[1].DayPeriod) == (6, 1, 3)
    assert (got[2].Month, got[2].DayOfWeekNum, got[2].DayPeriod) == (4, 5, 0)
    with pytest.raises(Exception):
        S.request_features(req, lenient=False).collect()


def test_default_now_is_pacific_wall_clock(spark):
    row = spark.range(1).select(S.now_in_zone().alias("t"), F.current_timestamp().alias("u")).first()
    # Pacific time is 7 or 8 hours behind UTC; session zone is UTC
    diff_h = (row.u.replace(tzinfo=None) - row.t).total_seconds() / 3600
    assert 6.9 < diff_h < 8.1


def test_expand_boxes_and_fixed_slot(spark):
    req = spark.createDataFrame([("2015-01-01 10:00:00",)], "request string")
    grid = S.expand_boxes(S.distinct_slots(S.with_fixed_slot(S.request_features(req, now=NOW))))
    rows = grid.collect()
    assert len(rows) == 166 and sorted(r.Box for r in rows) == list(range(166))
    assert {(r.Month, r.DayOfWeekNum, r.DayPeriod) for r in rows} == {S.REFERENCE_SLOT}


def test_history_scores_match_brute_force(spark, labelled_small):
    hist = {(r.Box, r.Month, r.DayOfWeekNum, r.DayPeriod): int(r.label) for r in labelled_small.collect()}
    req = spark.createDataFrame([("2024-01-05 08:00:00",), ("2024-01-05 09:30:00",), ("2024-03-10 23:00:00",)],
                                "request string")
    feats = S.request_features(req, now=NOW)
    cube = S.slot_cube(labelled=labelled_small)
    assert cube.count() == S.N_SLOTS * 166
    scored = S.score_requests(feats, cube).collect()
    assert len(scored) == 3 * 166
    for r in scored:
        assert r.pred == hist.get((r.Box, r.Month, r.DayOfWeekNum, r.DayPeriod), 0)
    means = {r.request: r for r in S.request_mean_risk(feats, cube).collect()}
    for text, m in means.items():
        preds = [r.pred for r in scored if r.request == text]
        assert m.mean_risk_compat == pytest.approx(sum(preds) / 165.0)
        assert m.mean_risk == pytest.approx(sum(preds) / 166.0) and m.boxes == 166


def test_tree_scoring_flow_and_single_file(spark, labelled_small, tmp_path):
    model = T.train_tree(labelled_small)
    req = spark.createDataFrame([("2015-01-01 10:00:00",)], "request string")
    per_box, mean = scoring.score_texts(req, model, fixed_slot=S.REFERENCE_SLOT, now=NOW)
    rows = per_box.collect()
    assert len(rows) == 166 and {r.pred for r in rows} <= {0, 1, 2}
    direct = {b: int(T.predict_vector(model, [b, 8, 2, 1])) for b in (0, 72, 165)}
    assert all(r.pred == direct[r.Box] for r in rows if r.Box in direct)
    assert mean.count() == 1
    out = str(tmp_path / "useroutput")
    scoring.write_single_request(per_box, out)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    with open(os.path.join(out, files[0])) as f:
        lines = f.read().splitlines()
    assert len(lines) == 166 and [int(x.split(",")[0]) for x in lines] == list(range(166))


def test_heatmap_layout(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (13, 2), (14, 0), (165, 1)], "Box int, pred int")
    compat = {r.Box: (r.position, r.row, r.col, r.colour) for r in H.layout(df).collect()}
    assert 0 not in compat  # box 0 is never drawn by the page
    assert compat[1][:3] == (1, 1, 1) and compat[13][:3] == (13, 1, 13) and compat[14][:3] == (14, 2, 1)
    assert compat[165][:3] == (165, 13, 9)
    assert compat[13][3] == "rgba(255,87,115,0.6)" and compat[14][3] == "rgba(111,232,202,0.6)"
    fixed = {r.Box: (r.position, r.row, r.col) for r in H.layout(df, width=15, compat=False).collect()}
    assert fixed[0] == (1, 1, 1) and fixed[14] == (15, 1, 15) and fixed[165] == (166, 12, 1)


def test_streaming_scorer(spark, labelled_small, tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    (folder / "a.txt").write_text("2015-01-01 10:00:00\n")
    (folder / "b.txt").write_text("2015-05-29 23:40:00\nnot a date\n")
    cube = ST.slot_cube(spark, GridSpec(), labelled=labelled_small)
    out = str(tmp_path / "scored")
    q = ST.start(spark, str(folder), out, cube, checkpoint=str(tmp_path / "ckpt"), now=NOW, available_now=True, expand=True)
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == 3 * 166
    assert res.filter(~F.col("valid")).select("request").distinct().first().request == "not a date"
    # a second file arriving later is picked up by the next run, earlier ones are not redone
    (folder / "c.txt").write_text("2015-07-04 12:00:00\n")
    q2 = ST.start(spark, str(folder), out, cube, checkpoint=str(tmp_path / "ckpt"), now=NOW, available_now=True, expand=True)
    q2.awaitTermination(120)
    assert spark.read.parquet(out).count() == 4 * 166
    # by default one row per request, with the same levels
    short = str(tmp_path / "levels")
    q3 = ST.start(spark, str(folder), short, cube, checkpoint=str(tmp_path / "ckpt3"), now=NOW, available_now=True)
    q3.awaitTermination(120)
    levels = {r.request: list(r.levels) for r in spark.read.parquet(short).collect()}
    assert len(levels) == 4
    for r in spark.read.parquet(out).collect():
        assert levels[r.request][r.Box] == r.pred


def test_batch_request_files(spark, tmp_path):
    from georisk.sources.requests import read_requests
    d = tmp_path / "req"
    d.mkdir()
    (d / "one.txt").write_text("2015-01-01 10:00:00\n\n2015-01-02 23:00:00\n")
    (d / "two.txt").write_text("2015-01-03 12:00:00\n")
    req = read_requests(spark, str(d))
    assert req.count() == 3
    feats = S.request_features(req, lenient=False).collect()
    assert sorted((r.DayOfWeekNum, r.DayPeriod) for r in feats) == [(4, 1), (5, 0), (6, 2)]


def test_broadcast_only_below_bound(spark):
    from georisk.plans.broadcast import MAX_BROADCAST_ROWS, bounded_broadcast
    from georisk.plans.inspect import plan_text
    df = spark.range(10)
    assert "broadcast" in plan_text(bounded_broadcast(df, 10), "extended").lower()
    assert "broadcast" not in plan_text(bounded_broadcast(df, MAX_BROADCAST_ROWS + 1), "extended").lower()


def test_finer_grid_end_to_end(spark):
    """Region size is a parameter: a 4x finer, alias-free grid keeps every incident
    in exactly one box below its bound, and slot bounds grow with it."""
    from georisk.operators import cells as C
    from georisk.sources.incidents import incidents_from_tables
    fine = GridSpec(cell=0.0025).full_stride()
    inc = incidents_from_tables(spark, "/root/testdata/sf0.001", fine)
    cells = C.box_agg(inc)
    agg = cells.agg(F.sum("Count").alias("n"), F.max("Box").alias("b")).first()
    assert agg.n == inc.count() == 5705 and agg.b < fine.n_boxes
    assert C.slot_bound(fine) > C.slot_bound(GridSpec())
    rows = inc.select("X", "Y", "Box").collect()
    assert all(r.Box == fine.box_of(r.X, r.Y) for r in rows)


def test_now_literal_ignores_zones(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        req = spark.createDataFrame([("garbage",)], "request string")
        got = S.request_features(req, now=dt.datetime(2016, 7, 4, 19, 30, 5, 250000)).first()
        assert got.request_ts == dt.datetime(2016, 7, 4, 19, 30, 5, 250000) and got.DayPeriod == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
