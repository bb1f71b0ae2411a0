"""Quoted line feeds read in many tasks: equal to the one-task reader, by block size."""

import random

import pytest
from pyspark.sql import functions as F

from georisk.queries import DOC_NULL, DOC_SCHEMA
from georisk.sources import csv as CSV
from georisk.sources import quoted as QC
from tests.conftest import SF0001

SCHEMA = "a string, b string, c int"


@pytest.fixture
def blocks_of(spark):
    """Sets the bytes of a block, and back again."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}

    def set_(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield set_
    for n, v in old.items():
        spark.conf.set(n, v)


def awkward_rows(seed, n):
    r = random.Random(seed)
    parts = ["", "x", '"', '""', "\n", "\n\n", ",", "é\n", '",\n"', "long " * 40, " lead", "trail ", "#"]
    return [("".join(r.choices(parts, k=r.randint(0, 6))) + "k", "".join(r.choices(parts, k=r.randint(0, 30))) + "k", i) for i in range(n)]


@pytest.mark.parametrize("block", [64, 300, 1 << 20])
def test_awkward_fields_over_any_blocks(spark, blocks_of, tmp_path, block):
    rows = awkward_rows(block, 400)
    path = str(tmp_path / "x")
    CSV.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    blocks_of(block)
    df = QC.read_quoted_csv(spark, path, SCHEMA)
    assert sorted(map(tuple, df.collect()), key=lambda x: x[2]) == rows
    if block == 300:
        assert spark.read.text(path).rdd.getNumPartitions() > 40


def test_documents_as_the_one_task_reader(spark, blocks_of, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    path = str(tmp_path / "docs")
    CSV.write_csv(docs.coalesce(1), path, null_value=DOC_NULL)
    whole = CSV.read_csv(spark, path, DOC_SCHEMA, multi_line=True, null_value=DOC_NULL)
    blocks_of(20_000)
    split = QC.read_quoted_csv(spark, path, DOC_SCHEMA, null_value=DOC_NULL)
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count() == docs.count()


def test_a_record_longer_than_many_blocks(spark, blocks_of, tmp_path):
    rows = [("a", "first", 1), ("b", "line\n" * 2000, 2), ("c", "last", 3)]
    path = str(tmp_path / "x")
    CSV.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    blocks_of(500)
    assert sorted(map(tuple, QC.read_quoted_csv(spark, path, SCHEMA).collect())) == rows


def test_headers_by_position(spark, tmp_path):
    for name, body in (("p1", 'a,b,c\n"x\ny",1,1\n'), ("p2", "a,b,c\r\n\r\n#no\r\nz,2,2\r\n"), ("p3", "")):
        (tmp_path / name).write_bytes(body.encode())
    def read(header):
        return sorted((r.a, r.b, r.c) for r in QC.read_quoted_csv(spark, str(tmp_path), SCHEMA, header=header, comment="#").collect())
    assert read(True) == [("x\ny", "1", 1), ("z", "2", 2)]
    assert [r[:2] for r in read("first")] == [("a", "b"), ("x\ny", "1"), ("z", "2")]
    assert [r[0] for r in read(False)] == ["a", "a", "x\ny", "z"]
    with pytest.raises(ValueError):
        QC.read_quoted_csv(spark, str(tmp_path), SCHEMA, header="last")


def raw_line(i, x="-122.42"):
    return f'{i},"LARCENY","A ""B"",\nC",Monday,05/11/2015,10:30,NORTHERN,NONE,800 Block,{x},37.77,"(37.77, -122.42)",{i}9'


def test_incidents_with_line_feeds_and_the_first_header_only(spark, blocks_of, tmp_path):
    for name in ("p1", "p2"):
        (tmp_path / name).write_text("\n".join([CSV.HEADER_LINE, *[raw_line(i) for i in range(30)], raw_line(99, "")]) + "\n")
    blocks_of(400)
    def read(**kw):
        return CSV.read_incidents_csv(spark, str(tmp_path), multi_line="split", **kw)
    assert read(lenient=True).count() == 60
    assert {r.Descript for r in read(lenient=True).collect()} == {'A "B",\nC'}
    # the second file's header is a record, as for a reader that only drops the first line of all
    assert read(lenient=True, header="first").count() == 60
    with pytest.raises(Exception, match="malformed incident record"):
        read(header="first").select(F.sum("X")).collect()
    (tmp_path / "p2").write_text("\n".join(raw_line(i) for i in range(5)) + "\n")
    (tmp_path / "p1").write_text("\n".join([CSV.HEADER_LINE, raw_line(7)]) + "\n")
    assert read(header="first").count() == 6 and read(header=True).count() == 5  # True would lose a record here
