"""The two end-to-end jobs: train (profile → slots → tree → evaluation → saved
model) and score (requests → every box → ``box,pred`` file / result tables).

Every printed figure is a one-row or few-row aggregate computed on the
executors; nothing but those summaries reaches the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.risk import LOW_BELOW, MEDIUM_BELOW
from georisk.operators import cells as C
from georisk.operators import heatmap as H
from georisk.operators import profile as P
from georisk.operators import score as S
from georisk.operators import tree as T
from georisk.plans import scoring, training
from georisk.sources import parquet as PQ
from georisk.sources.csv import read_incidents_csv
from georisk.sources.incidents import CELL_KEYS, DATE_MODES, publish
from georisk.sources.requests import read_requests

# Fixed value: the slot (Box, Month, DayOfWeekNum, DayPeriod) whose prediction the train report shows.
PROBE = (72, 8, 2, 1)


def load_incidents(spark: SparkSession, source: str, fmt: str = "csv", grid: GridSpec = GridSpec(),
                   date_mode: str = "real", lenient: bool = False, keep_out_of_bounds: bool = False) -> DataFrame:
    """Typed incidents; ``keep_out_of_bounds`` keeps all rows and adds ``in_bounds``."""
    if fmt == "csv":
        return read_incidents_csv(spark, source, grid, date_mode=date_mode, lenient=lenient,
                                  keep_out_of_bounds=keep_out_of_bounds)
    if fmt == "parquet":
        if keep_out_of_bounds:
            rows = PQ.read_incidents(spark, source, date_mode=date_mode, lenient=lenient)
            return rows.withColumn("Box", grid.box_id("X", "Y")).withColumn("in_bounds", grid.in_bounds("X", "Y"))
        return PQ.read_incidents(spark, source, grid, date_mode=date_mode, lenient=lenient)
    raise ValueError("fmt must be csv or parquet")


def _show(report: Callable[[str, DataFrame], None] | None):
    def out(title: str, df: DataFrame) -> None:
        if report is not None:
            report(title, df)
    return out


def print_report(title: str, df: DataFrame) -> None:
    print(f"== {title}")
    df.show(truncate=False)


def train_job(spark: SparkSession, source: str, model_path: str, fmt: str = "csv", grid: GridSpec = GridSpec(),
              split_mode: str = "hash", report: Callable[[str, DataFrame], None] | None = print_report,
              lenient: bool = False, date_mode: str = "real", low_below: int = LOW_BELOW,
              medium_below: int = MEDIUM_BELOW) -> training.TrainingResult:
    show = _show(report)
    everything = load_incidents(spark, source, fmt, grid, date_mode, lenient, keep_out_of_bounds=True)
    publish(everything.filter("in_bounds").drop("in_bounds"), "incidents")
    # the only pass over the incidents: everything below reads these bounded aggregates
    sets = T.materialize(P.profile_sets(everything))
    overall = P.profile_part(sets, [])
    show("raw, kept and rejected rows", overall.select(
        F.col("raw").alias("raw_rows"), F.col("n").alias("kept_rows"), (F.col("raw") - F.col("n")).alias("rejected_rows")))
    show("extent", overall.select("min_x", "max_x", "min_y", "max_y"))
    show("ranges", overall.select(*[f"{m}_{c}" for c in ("box", "hour", "day_period", "month") for m in ("min", "max")]))
    show("count by weekday name", P.profile_part(sets, ["DayOfWeek"]).select("DayOfWeek", "n").orderBy("DayOfWeek"))
    show("time span", overall.select("min_ts", "max_ts"))
    show("per (Box, Date) counts", P.box_date_stats(P.profile_part(sets, ["Box", "Date"])))
    cells = P.sets_cells(sets)
    show("count by weekday", cells.groupBy("DayOfWeekNum").agg(F.sum("Count").alias("n")).orderBy("DayOfWeekNum"))
    labelled = T.materialize(C.label_cells(cells, low_below, medium_below))
    show("slots", labelled.agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("label") == 0).alias("low_slots")))
    show("first slots", P.preview(labelled, [F.col("Count").desc(), *CELL_KEYS]))
    res = training.train_labelled(labelled, split_mode, model_path, grid)
    show("slots per label", res.labelled.groupBy("label").count().orderBy("label"))
    probe = spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(CELL_KEYS, PROBE)])
    show("prediction for one slot", T.predict(res.model, probe))
    show("test error", res.error())
    show("precision / recall", res.per_class().orderBy("class"))
    show("macro averages", res.macro())
    return res


def score_job(spark: SparkSession, model_path: str, requests_path: str, out_path: str,
              grid: GridSpec = GridSpec(), fixed_slot: tuple[int, int, int] | None = None,
              single_file: bool = True, now: dt.datetime | None = None, strict: bool = False, expand: bool = False,
              report: Callable[[str, DataFrame], None] | None = print_report) -> scoring.Scores:
    """Score every request and keep all results below ``out_path``.

    With ``single_file`` (one request) the ``box,pred`` file is written there.
    Otherwise it holds Parquet tables: ``requests`` (request, time, ``valid``, slot),
    ``cube`` (slot, Box, pred), ``mean_risk`` (one row per request) and ``heatmap``
    (the map of every requested slot); with ``expand`` also ``scores``, one row per
    request and box. ``strict`` raises on a request that is no timestamp; otherwise
    it is scored at the current time and marked as not valid.
    """
    model = T.load_model(model_path)
    requests = read_requests(spark, requests_path)
    if single_file and requests.limit(2).count() != 1:
        raise ValueError("the box,pred file holds one request; use table output for several")
    s = scoring.score(requests, model, grid, fixed_slot=fixed_slot, now=now, lenient=not strict)
    mean = s.mean.select("request", "request_ts", "valid", *S.SLOT_KEYS, "mean_risk_compat", "mean_risk")
    if single_file:
        scoring.write_single_request(s.expanded(), out_path)
        _show(report)("mean risk", mean)
        return s
    s.requests.write.parquet(f"{out_path}/requests")
    s.cube.write.parquet(f"{out_path}/cube")
    mean.write.parquet(f"{out_path}/mean_risk")
    cube = spark.read.parquet(f"{out_path}/cube")
    asked = spark.read.parquet(f"{out_path}/requests").select(*S.SLOT_KEYS).distinct()
    H.layout(S.join_slots(cube, asked, S.N_SLOTS), compat=False, width=grid.stride).write.parquet(f"{out_path}/heatmap")
    if expand:
        s.expanded().select("request", "request_ts", "valid", "Box", "pred").write.parquet(f"{out_path}/scores")
    _show(report)("mean risk of the first requests (all are in mean_risk)", mean)
    return s


def grid_from(a: argparse.Namespace) -> GridSpec:
    """The default grid with the given options; the stride avoids shared ids unless it is given."""
    given = {k: getattr(a, k) for k in ("min_x", "max_x", "min_y", "max_y", "cell") if getattr(a, k) is not None}
    grid = replace(GridSpec(), **given)
    if a.stride:
        return replace(grid, stride=a.stride)
    return grid.full_stride() if given else grid


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of the input files, from the file system that holds them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def main(argv: list[str] | None = None) -> None:
    from georisk.session import build_session, scale_conf
    ap = argparse.ArgumentParser(prog="georisk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--source", required=True)
    t.add_argument("--format", default="csv", choices=["csv", "parquet"])
    t.add_argument("--split", default="hash", choices=["hash", "random"])
    t.add_argument("--lenient", action="store_true")
    t.add_argument("--date-mode", default="real", choices=DATE_MODES)
    t.add_argument("--low-below", type=int, default=LOW_BELOW)
    t.add_argument("--medium-below", type=int, default=MEDIUM_BELOW)
    s = sub.add_parser("score")
    s.add_argument("--requests", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--reference-slot", action="store_true", help="score the constant slot (8, 2, 1)")
    s.add_argument("--table", action="store_true", help="many requests: write Parquet tables")
    s.add_argument("--expand", action="store_true", help="also write one row per request and box")
    s.add_argument("--strict", action="store_true", help="fail on a request that is no timestamp")
    for p in (t, s):
        p.add_argument("--model", required=True)
        for bound in ("min-x", "max-x", "min-y", "max-y", "cell"):
            p.add_argument(f"--{bound}", type=float)
        p.add_argument("--stride", type=int, help="boxes per row; wide enough for unique ids if a grid option is given")
    a = ap.parse_args(argv)
    spark = build_session()
    source = a.source if a.cmd == "train" else a.requests
    for k, v in scale_conf(input_bytes(spark, source), spark.sparkContext.defaultParallelism).items():
        spark.conf.set(k, v)
    if a.cmd == "train":
        train_job(spark, a.source, a.model, a.format, grid_from(a), a.split, lenient=a.lenient, date_mode=a.date_mode,
                  low_below=a.low_below, medium_below=a.medium_below)
    else:
        score_job(spark, a.model, a.requests, a.out, grid_from(a), S.REFERENCE_SLOT if a.reference_slot else None,
                  single_file=not a.table, strict=a.strict, expand=a.expand)
    spark.stop()
