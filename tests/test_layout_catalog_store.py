"""Curve layout, footers, counts on the way, clustered table, count store."""

import glob
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.operators import cells as C
from georisk.operators import incremental as INC
from georisk.operators import profile as P
from georisk.sources import catalog as CAT
from georisk.sources import parquet as PQ
from georisk.sources.incidents import incidents_from_tables
from tests.conftest import SF001, SF0001


@pytest.fixture(scope="module")
def everything(spark):
    return incidents_from_tables(spark, SF0001, keep_out_of_bounds=True).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def interleaved(x, y):
    return sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(16))


def test_curve_key_interleaves_bits(spark):
    g, top = GridSpec(), (1 << 16) - 1
    rows = [(g.min_x, g.min_y), (g.max_x, g.min_y), (g.min_x, g.max_y), (g.max_x + 1, g.max_y + 1), (g.min_x - 9, g.max_y),
            (-122.44, 37.77), (-122.50001, 37.7001)]
    got = [r.k for r in spark.createDataFrame(rows, "X double, Y double").coalesce(1).select(PQ.curve_key(g).alias("k")).collect()]

    def cell(v, low, high):
        return int(min(max((v - low) / (high - low), 0), 1) * top)

    assert got == [interleaved(cell(x, g.min_x, g.max_x), cell(y, g.min_y, g.max_y)) for x, y in rows]


def groups_met(path, box):
    """(row groups whose statistics meet the box, all row groups)."""
    met = total = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        names = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)} if meta.num_row_groups else {}
        for g in range(meta.num_row_groups):
            x, y = (meta.row_group(g).column(names[c]).statistics for c in ("X", "Y"))
            total += 1
            met += x.min <= box[1] and x.max >= box[0] and y.min <= box[3] and y.max >= box[2]
    return met, total


def test_a_box_meets_few_row_groups_along_the_curve(spark, tmp_path):
    """Many row groups in each grid cell, as in a large table: points spread over 3 x 3 cells, and a box as
    large as one cell (a ninth of the area) that lies across four of them."""
    g, n = GridSpec(), 40_000
    low_x, low_y, side = g.min_x + 5 * g.cell, g.min_y + 4 * g.cell, 3 * g.cell

    def even(low, prime):
        return F.lit(low) + F.lit(side) * (F.pmod(F.xxhash64("PdId", F.lit(prime)), F.lit(prime)) / prime)

    rows = incidents_from_tables(spark, SF001).limit(n).withColumn("X", even(low_x, 9973)).withColumn("Y", even(low_y, 9967)) \
        .withColumn("Box", g.box_id("X", "Y")).withColumn("Timestamp", F.lit("2015-01-01").cast("timestamp_ntz")).cache()
    box = (low_x + g.cell / 2, low_x + 1.5 * g.cell, low_y + g.cell / 2, low_y + 1.5 * g.cell)
    inside = rows.filter(F.col("X").between(*box[:2]) & F.col("Y").between(*box[2:])).count()
    share = {}
    for layout in PQ.LAYOUTS:
        path = str(tmp_path / layout)
        PQ.write_incidents(rows, path, rows_per_file=100, layout=layout)
        met, total = groups_met(path, box)
        assert total >= 300
        share[layout] = met / total
        back = PQ.read_incidents(spark, path, GridSpec(box[0], box[1], box[2], box[3]), lenient=True)
        assert abs(back.count() - inside) <= 5  # bounds are compared as 32-bit floats
        assert "PushedFilters: [" in plan(back) and "GreaterThanOrEqual(X" in plan(back)
    assert share["curve"] < 0.2 and share["box"] > 2 * share["curve"]
    with pytest.raises(ValueError):
        PQ.write_incidents(rows, str(tmp_path / "x"), layout="spiral")


def test_footers_answer_the_profile(spark, everything, tmp_path):
    path = str(tmp_path / "in-box")
    seen = PQ.write_in_box(everything, path)
    want = P.stage_counts(everything).first()
    assert seen == {"raw_rows": want.raw_rows, "kept_rows": want.kept_rows, "rejected_rows": want.rejected_rows}
    df = PQ.footer_profile(spark, path)
    assert "PushedAggregation: [COUNT(*)" in plan(df) and "MAX(Y)" in plan(df)
    rows = everything.filter("in_bounds")
    x = rows.agg(F.count(F.lit(1)), *[f(c) for c in PQ.FOOTER_COLUMNS for f in (F.min, F.max)]).first()
    assert tuple(df.first()) == tuple(x)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # the caller's settings are as before


def test_counts_on_the_way_of_nothing(spark, everything, tmp_path):
    assert PQ.write_in_box(everything.filter("false"), str(tmp_path / "x")) == {"raw_rows": 0, "kept_rows": 0, "rejected_rows": 0}


def test_clustered_table_aggregates_without_an_exchange(spark, everything):
    rows = everything.filter("in_bounds").drop("in_bounds")
    name = f"t_{uuid.uuid4().hex}"
    table = CAT.save_clustered(rows, name, buckets=7)
    for got, want in ((C.box_agg(table), C.box_agg(rows)),
                      (CAT.box_date_counts(table), rows.groupBy("Box", "Date").agg(F.count(F.lit(1)).alias("Count")))):
        got.collect()
        assert "Exchange" not in plan(got)
        assert same(got, want)
    assert spark.newSession().table(name).count() == rows.count()  # another session's SQL sees it
    spread = table.groupBy("Box").agg(F.count_distinct("Month").alias("m")).agg(F.max("m")).first()[0]
    assert spread > 1  # a box's months lie in different buckets


def even_odd(everything, part):
    return everything.drop("in_bounds").filter(F.col("IncidntNum") % 2 == part)


def test_count_store(spark, everything, tmp_path, monkeypatch):
    source, root = str(tmp_path / "files"), str(tmp_path / "store")
    rows, read = everything.filter("in_bounds").drop("in_bounds"), []

    def reader(spark, paths):
        read.append(paths)
        return INC.read_parquet_files(spark, paths)

    even_odd(everything, 0).write.parquet(source)
    first = INC.absorb(spark, source, root, reader)
    assert INC.absorb(spark, source, root, reader) is None and len(read) == 1  # nothing new, nothing read
    assert same(INC.slot_counts(spark, root), C.box_agg(rows.filter("IncidntNum % 2 = 0")))

    # A run that is lost after its counts and before its ledger rows: its counts are not read ...
    even_odd(everything, 1).write.mode("append").parquet(source)
    put = INC._put

    def lost(df, root, name):
        if name == "ledger":
            raise RuntimeError("lost")
        put(df, root, name)

    monkeypatch.setattr(INC, "_put", lost)
    with pytest.raises(RuntimeError):
        INC.absorb(spark, source, root, reader)
    monkeypatch.setattr(INC, "_put", put)
    assert same(INC.slot_counts(spark, root), C.box_agg(rows.filter("IncidntNum % 2 = 0")))
    # ... and the run that follows it counts no file twice.
    second = INC.absorb(spark, source, root, reader)
    assert second != first and not set(read[-1]) & set(read[0])
    assert same(INC.slot_counts(spark, root), C.box_agg(rows))
    assert same(INC.box_date_counts(spark, root), rows.groupBy("Box", "Date").agg(F.count(F.lit(1)).alias("Count")))

    # Lost again, then more files come before the next run: the lost batch stays unread.
    even_odd(everything, 0).limit(500).write.mode("append").parquet(source)
    monkeypatch.setattr(INC, "_put", lost)
    with pytest.raises(RuntimeError):
        INC.absorb(spark, source, root, reader)
    monkeypatch.setattr(INC, "_put", put)
    even_odd(everything, 1).limit(300).write.mode("append").parquet(source)
    INC.absorb(spark, source, root, reader)
    whole = PQ.read_incidents(spark, source, GridSpec())
    assert same(INC.slot_counts(spark, root), C.box_agg(whole))
    assert INC.slot_counts(spark, root).agg(F.sum("Count")).first()[0] == whole.count() > rows.count()


def test_a_changed_file_is_an_error(spark, everything, tmp_path):
    source, root = str(tmp_path / "files"), str(tmp_path / "store")
    even_odd(everything, 0).limit(50).coalesce(1).write.parquet(source)
    INC.absorb(spark, source, root)
    (name,) = glob.glob(f"{source}/*.parquet")
    even_odd(everything, 1).limit(70).toPandas().to_parquet(name)
    crc = glob.glob(f"{source}/.*.crc")
    assert crc  # Hadoop's sums of the old file; only its listing is read here
    with pytest.raises(Exception, match="counted file has changed"):
        INC.absorb(spark, source, root)


def test_an_empty_store(spark, tmp_path):
    root = str(tmp_path / "none")
    assert INC.slot_counts(spark, root).collect() == [] and INC.box_date_counts(spark, root).collect() == []
