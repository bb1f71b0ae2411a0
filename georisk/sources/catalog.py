"""Incidents as a catalog table, clustered so that counts per slot and per (Box, Date) need no exchange.

The table is bucketed by (Box, Month): a box's months lie in different buckets, so a box with
a third of all incidents still spreads over twelve of them. Slot counts group by Box and Month
anyway; a Date fixes its Month (in both date modes), so counts per (Box, Date) group by Month too
and drop it again. Both then aggregate within the tasks that scan the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georisk.session import shared_path

CLUSTERED = ("Box", "Month")
BUCKETS = 64


def save_clustered(incidents: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Save ``incidents`` as table ``name``, its files below the shared folder (or at ``path``);
    every session of the catalog can read it."""
    spark = incidents.sparkSession
    (incidents.repartition(buckets, *CLUSTERED).write.bucketBy(buckets, *CLUSTERED).sortBy(*CLUSTERED)
     .option("path", path or shared_path(spark, f"table-{name}")).saveAsTable(name))
    return spark.table(name)


def box_date_counts(table: DataFrame) -> DataFrame:
    """(Box, Date, Count) from a clustered table."""
    return table.groupBy("Box", "Month", "Date").agg(F.count(F.lit(1)).alias("Count")).select("Box", "Date", "Count")
