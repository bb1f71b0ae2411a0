"""Bounding box and grid cells ("boxes").

A box id is ``row * stride + col`` with ``row = trunc((y - min_y) / cell)`` and
``col = trunc((x - min_x) / cell)``. The default stride (15) is smaller than
the number of columns an inclusive x range of 15.6 cells spans (16), so the
last column of one row shares its id with the first column of the next row;
that aliasing is kept for parity and :meth:`GridSpec.full_stride` gives the
alias-free variant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for equal results:
# bounding box x -122.516 .. -122.360, y 37.700 .. 37.809, cell size 0.01,
# box-id stride 15.
DEFAULT_MIN_X = -122.516
DEFAULT_MAX_X = -122.360
DEFAULT_MIN_Y = 37.700
DEFAULT_MAX_Y = 37.809
DEFAULT_CELL = 0.01
DEFAULT_STRIDE = 15


def float_spacing(bound: float) -> float:
    """An upper bound of the gap between neighbouring 32-bit floats at ``bound``:
    24 significant bits, and 2**-149 next to zero."""
    return abs(bound) * 2.0**-22 + 2.0**-149


@dataclass(frozen=True)
class GridSpec:
    min_x: float = DEFAULT_MIN_X
    max_x: float = DEFAULT_MAX_X
    min_y: float = DEFAULT_MIN_Y
    max_y: float = DEFAULT_MAX_Y
    cell: float = DEFAULT_CELL
    stride: int = DEFAULT_STRIDE

    # ---- driver-side scalars (constants only, no data) ----
    def extent_cells(self) -> tuple[float, float]:
        """Grid extent in cells along x and y (15.6000…, 10.8999… by default)."""
        return (self.max_x - self.min_x) / self.cell, (self.max_y - self.min_y) / self.cell

    def box_of(self, x: float, y: float) -> int:
        # int() truncates toward zero, like the JVM's Double.toInt
        return int((y - self.min_y) / self.cell) * self.stride + int((x - self.min_x) / self.cell)

    def corner_ids(self) -> tuple[int, int, int, int]:
        """Ids of (minX,minY), (minX,maxY), (maxX,minY), (maxX,maxY)."""
        return (self.box_of(self.min_x, self.min_y), self.box_of(self.min_x, self.max_y),
                self.box_of(self.max_x, self.min_y), self.box_of(self.max_x, self.max_y))

    @property
    def n_boxes(self) -> int:
        """Number of box ids 0..box_of(maxX, maxY); the size bound of any per-box table."""
        return self.box_of(self.max_x, self.max_y) + 1

    def full_stride(self) -> "GridSpec":
        """Same grid with a stride wide enough that no two cells share an id."""
        ex, _ = self.extent_cells()
        return replace(self, stride=int(math.floor(ex)) + 1)

    # ---- Column expressions (Catalyst-visible, whole-stage codegen) ----
    def in_bounds(self, x: Column | str, y: Column | str) -> Column:
        """Inclusive box test on float-rounded coordinates against double bounds."""
        xf = F.col(x) if isinstance(x, str) else x
        yf = F.col(y) if isinstance(y, str) else y
        return (xf.cast("float").between(F.lit(self.min_x), F.lit(self.max_x))
                & yf.cast("float").between(F.lit(self.min_y), F.lit(self.max_y)))

    def prefilter(self, x: Column | str, y: Column | str) -> Column:
        """A widened plain-double range implied by :meth:`in_bounds`.

        The float cast in ``in_bounds`` hides the predicate from Parquet; when X
        and Y are stored columns this redundant range is what reaches
        ``PushedFilters`` (row-group skipping). Each bound is widened by the
        spacing of 32-bit floats at that bound, whatever its magnitude.
        """
        return reduce(and_, [bound for bound, _ in self.prefilter_bounds(x, y)])

    def prefilter_bounds(self, x: Column | str, y: Column | str) -> list[tuple[Column, Column | str]]:
        """The four bounds of :meth:`prefilter`, each with the column it tests."""
        out = []
        for v, low, high in ((x, self.min_x, self.max_x), (y, self.min_y, self.max_y)):
            c = F.col(v) if isinstance(v, str) else v
            out += [(c >= F.lit(low - float_spacing(low)), v), (c <= F.lit(high + float_spacing(high)), v)]
        return out

    def box_id(self, x: Column | str, y: Column | str) -> Column:
        xf = F.col(x) if isinstance(x, str) else x
        yf = F.col(y) if isinstance(y, str) else y
        row = ((yf - F.lit(self.min_y)) / F.lit(self.cell)).cast("int")
        col = ((xf - F.lit(self.min_x)) / F.lit(self.cell)).cast("int")
        return row * F.lit(self.stride) + col

    def box_row(self, box: Column | str) -> Column:
        b = F.col(box) if isinstance(box, str) else box
        return F.floor(b / F.lit(self.stride)).cast("int")

    def box_col(self, box: Column | str) -> Column:
        b = F.col(box) if isinstance(box, str) else box
        return F.pmod(b, F.lit(self.stride)).cast("int")
