"""Heat-map layout of box scores: position → (row, column) on a fixed-width page,
and a colour per risk level. Pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the map page: 13 cells per row; colours
# Low rgba(111,232,202,0.6), Medium rgba(241,241,135,0.6), High rgba(255,87,115,0.6).
PAGE_WIDTH = 13
COLOURS = ("rgba(111,232,202,0.6)", "rgba(241,241,135,0.6)", "rgba(255,87,115,0.6)")


def colour(pred: F.Column) -> F.Column:
    out = F.when(pred == 0, F.lit(COLOURS[0]))
    for level in range(1, len(COLOURS)):
        out = out.when(pred == level, F.lit(COLOURS[level]))
    return out


def layout(scores: DataFrame, width: int = PAGE_WIDTH, compat: bool = True) -> DataFrame:
    """Adds position, row, col, colour.

    ``compat``: box b is drawn at position b and box 0 is not drawn (the page
    reads the header-less file as if it had a header). Otherwise box b goes to
    position b + 1. Column = position mod width, with 0 meaning ``width``;
    row = ceil(position / width).
    """
    pos = F.col("Box") if compat else F.col("Box") + F.lit(1)
    df = scores.filter(pos > 0) if compat else scores
    p = pos
    col = F.when(p % width == 0, F.lit(width)).otherwise(p % width)
    row = F.ceil(p / F.lit(float(width))).cast("int")
    return df.select(*scores.columns, p.alias("position"), row.alias("row"), col.cast("int").alias("col"),
                     colour(F.col("pred")).alias("colour"))
