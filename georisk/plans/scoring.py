"""Scoring flow: request texts → slots → scores for every box → per-request rows,
mean risk, and the ``box,pred`` file for a single request."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame

from georisk.functions.grid import GridSpec
from georisk.operators import score as S
from georisk.sources.csv import write_scores


@dataclass
class Scores:
    """Requests with their slot, the scores of every (slot, box), and the mean risk of
    each request. ``requests`` joined with ``cube`` on the slot is the expanded form."""

    requests: DataFrame
    cube: DataFrame
    mean: DataFrame
    grid: GridSpec

    def expanded(self) -> DataFrame:
        return S.score_requests(self.requests, self.cube, self.grid)


def score(requests: DataFrame, model: DecisionTreeClassificationModel, grid: GridSpec = GridSpec(),
          text_col: str = "request", fixed_slot: tuple[int, int, int] | None = None,
          lenient: bool = True, now: dt.datetime | None = None) -> Scores:
    """``fixed_slot`` reproduces the reference scorer, which ignores the request and
    always uses (8, 2, 1). The cube has 336 slots whatever the number of requests."""
    req = S.request_features(requests, text_col, lenient=lenient, now=now)
    if fixed_slot is not None:
        req = S.with_fixed_slot(req, fixed_slot)
    cube = S.slot_cube(model=model, grid=grid, spark=requests.sparkSession)
    return Scores(req, cube, S.request_mean_risk(req, cube, grid), grid)


def score_texts(requests: DataFrame, model: DecisionTreeClassificationModel, grid: GridSpec = GridSpec(),
                **options) -> tuple[DataFrame, DataFrame]:
    """(per request x box scores, per request mean risk); see :func:`score`."""
    s = score(requests, model, grid, **options)
    return s.expanded(), s.mean


def write_single_request(scores: DataFrame, path: str) -> None:
    """The ``box,pred`` file of one request (n_boxes lines, box order, one file)."""
    write_scores(scores.select("Box", "pred"), path, single_file=True)
