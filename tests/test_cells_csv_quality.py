"""Slot counts and labels, CSV sources/sinks (edge cases of FIXTURES.md §6), audits."""

import os

import pytest
from pyspark.sql import functions as F

from georisk.functions.risk import risk_level
from georisk.operators import cells as C
from georisk.operators import quality as Q
from georisk.sources import csv as CSV
from georisk.sources.incidents import incidents_from_tables

from conftest import SF0001, SF001

HEADER = CSV.HEADER_LINE
README_LINES = [
    '150470464,OTHER OFFENSES,"DRIVERS LICENSE, SUSPENDED OR REVOKED",Friday,05/29/2015,23:40,MISSION,'
    '"ARREST, BOOKED",19TH ST / SHOTWELL ST,-122.415929849548,37.7604330003754,'
    '"(37.7604330003754, -122.415929849548)",15047046465016',
    '150470420,NON-CRIMINAL,"AIDED CASE, MENTAL DISTURBED",Friday,05/29/2015,23:36,INGLESIDE,NONE,'
    '4900 Block of MISSION ST,-122.438695075365,37.7196920262929,"(37.7196920262929, -122.438695075365)",'
    '15047042064020',
    '150470680,LARCENY/THEFT,GRAND THEFT PICKPOCKET,Friday,05/29/2015,23:30,NORTHERN,NONE,'
    '1200 Block of POLK ST,-122.420326993863,37.7884521578132,"(37.7884521578132, -122.420326993863)",'
    '15047068006113',
]


def write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.mark.parametrize("count,level", [(0, 0), (4, 0), (5, 1), (29, 1), (30, 2), (413, 2)])
def test_risk_level_boundaries(spark, count, level):
    assert spark.range(1).select(risk_level(F.lit(count)).alias("l")).first().l == level


def test_published_cells_get_published_labels(spark):
    # (Count, Box, Month, DayOfWeekNum, DayPeriod) → label, as printed by the reference
    rows = [(28, 72, 8, 2, 1), (30, 38, 1, 7, 1), (53, 111, 2, 6, 0), (19, 78, 9, 5, 3), (10, 79, 3, 4, 1)]
    df = spark.createDataFrame(rows, "Count long, Box int, Month int, DayOfWeekNum int, DayPeriod int")
    assert [r.label for r in C.label_cells(df).collect()] == [1.0, 2.0, 2.0, 1.0, 1.0]


@pytest.mark.parametrize("sf,kept,cells,levels,boxes,max_count", [
    (SF0001, 5705, 3360, {0: 3120, 1: 240}, 159, 16),
    (SF001, 57246, 15253, {0: 12712, 1: 2213, 2: 328}, 166, 106),
])
def test_fixture_sizes(spark, sf, kept, cells, levels, boxes, max_count):
    inc = incidents_from_tables(spark, sf)
    assert inc.count() == kept
    lab = C.label_cells(C.box_agg(inc))
    assert lab.count() == cells
    assert {int(r.label): r.n for r in C.label_counts(lab).collect()} == levels
    agg = lab.agg(F.countDistinct("Box").alias("b"), F.max("Count").alias("m")).first()
    assert (agg.b, agg.m) == (boxes, max_count)
    assert inc.schema["Box"].dataType.simpleString() == "int"
    assert lab.schema["Count"].dataType.simpleString() == "bigint"


def test_split_is_layout_independent(spark, labelled_mid):
    a = C.mark_split(labelled_mid)
    b = C.mark_split(labelled_mid.repartition(3))
    key = ["Box", "Month", "DayOfWeekNum", "DayPeriod", "split"]
    assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())
    tr, te = C.split_cells(labelled_mid)
    n = labelled_mid.count()
    assert tr.count() + te.count() == n
    assert 0.6 < tr.count() / n < 0.8


def test_random_split_option(labelled_mid):
    tr, te = C.split_cells(labelled_mid, "random")
    assert tr.count() + te.count() == labelled_mid.count()


def test_read_incidents_csv_default_and_verbatim(spark, tmp_path):
    p = str(tmp_path / "in" / "rows.csv")
    write_lines(p, [HEADER] + README_LINES)
    df = CSV.read_incidents_csv(spark, p).orderBy(F.col("Box").desc()).collect()
    assert [r.Box for r in df] == [129, 100, 22]
    assert df[1].Descript == "DRIVERS LICENSE, SUSPENDED OR REVOKED"
    vb = CSV.read_incidents_csv(spark, p, verbatim=True).orderBy(F.col("Box").desc()).collect()
    assert vb[1].Descript == '"DRIVERS LICENSE, SUSPENDED OR REVOKED"'
    assert vb[1].Resolution == '"ARREST, BOOKED"'
    assert [r.Box for r in vb] == [129, 100, 22]


def test_verbatim_split_keeps_13_fields_and_trailing_empties(spark):
    lines = spark.createDataFrame([(README_LINES[0],), ("a,,",), ('x,"a,b",',)], "value string")
    sizes = [r.n for r in lines.select(F.size(CSV.split_fields(F.col("value"))).alias("n")).collect()]
    assert sizes == [13, 3, 3]


def fields_by_hand(line):
    """Cut at commas that an even number of quotes follows."""
    out, field = [], ""
    for i, c in enumerate(line):
        if c == "," and line[i:].count('"') % 2 == 0:
            out.append(field)
            field = ""
        else:
            field += c
    return [*out, field]


def test_split_by_hand_and_long_lines(spark):
    import random
    r = random.Random(1)
    lines = ["", ",", '"', '","', 'a,"b,c",d"'] + ["".join(r.choices('a,"', k=r.randint(0, 15))) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in lines], "value string").select("value", CSV.split_fields(F.col("value")).alias("f")).collect()
    assert all(x.f == fields_by_hand(x.value) for x in got)
    long = spark.range(1).select(F.array_join(F.array_repeat(F.lit('"x,y"'), 100_000), ",").alias("value"))
    assert long.select(F.size(CSV.split_fields(F.col("value"))).alias("n")).first().n == 100_000


def test_two_files_each_with_header(spark, tmp_path):
    d = tmp_path / "two"
    write_lines(str(d / "a.csv"), [HEADER, README_LINES[0]])
    write_lines(str(d / "b.csv"), [HEADER, README_LINES[1], README_LINES[2]])
    assert CSV.read_incidents_csv(spark, str(d)).count() == 3
    assert CSV.read_incidents_csv(spark, str(d), verbatim=True).count() == 3


def test_bad_number_and_bad_date(spark, tmp_path):
    bad_num = README_LINES[0].replace("-122.415929849548", "west")
    bad_date = README_LINES[1].replace("05/29/2015", "13/45/2015")
    p = str(tmp_path / "bad" / "rows.csv")
    write_lines(p, [HEADER, bad_num, bad_date, README_LINES[2]])
    assert CSV.read_incidents_csv(spark, p, lenient=True).count() == 1
    with pytest.raises(Exception):
        CSV.read_incidents_csv(spark, p).collect()


def test_roundtrip_quotes_commas_newlines_empties(spark, tmp_path):
    rows = [(1, 'He said "hi", twice'), (2, "line one\nline two"), (3, ""), (4, None), (5, "  padded  "),
            (6, "a,,b")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    out = str(tmp_path / "rt")
    CSV.write_csv(df.repartition(3), out, null_value="\\N")
    back = CSV.read_csv(spark, out, "id bigint, text string", multi_line=True, null_value="\\N")
    assert sorted(back.collect()) == sorted(df.collect())
    # default: NULL is written as an empty field, and empty reads back as NULL
    out0 = str(tmp_path / "rt0")
    CSV.write_csv(df, out0)
    back0 = {r.id: r.text for r in CSV.read_csv(spark, out0, "id bigint, text string", multi_line=True).collect()}
    assert back0[3] is None and back0[4] is None and back0[2] == "line one\nline two"
    quoted = str(tmp_path / "rtq")
    CSV.write_csv(df, quoted, quote_all=True, sep=";", null_value="\\N")
    with open([os.path.join(quoted, f) for f in os.listdir(quoted) if f.endswith(".csv")][0]) as f:
        assert f.readline().strip() == '"id";"text"'
    back2 = CSV.read_csv(spark, quoted, "id bigint, text string", sep=";", multi_line=True, null_value="\\N")
    assert sorted(back2.collect()) == sorted(df.collect())


def test_comment_lines_and_blank_lines_skipped(spark, tmp_path):
    p = str(tmp_path / "c" / "x.csv")
    write_lines(p, ["a,b", "# a comment", "1,2", "", "3,4"])
    df = CSV.read_csv(spark, p, "a int, b int", comment="#")
    assert sorted(df.collect()) == [(1, 2), (3, 4)]


def test_malformed_rows(spark):
    lines = spark.createDataFrame([("a,b",), ("a",), ("a,b,c",), ('"open,b',), ('"x,y",z',), ("",)], "value string")
    got = {r.status: r.n for r in Q.malformed_rows(lines, 2).collect()}
    assert got == {"OK": 2, "TooFewFields": 1, "TooManyFields": 1, "MissingQuotes": 1}


def test_cell_type_profile(spark):
    df = spark.createDataFrame([("1", "true", " -1.5e3 ", "abc"), (".5", "false", "7.", None),
                                ("1e", "True", "-", "12:30")], "a string, b string, c string, d string")
    got = {(r.column, r.type): r.n for r in Q.cell_type_profile(df).collect()}
    assert got == {("a", "number"): 2, ("a", "string"): 1, ("b", "boolean"): 2, ("b", "string"): 1,
                   ("c", "number"): 2, ("c", "string"): 1, ("d", "string"): 2, ("d", "null"): 1}


def test_cast_audit(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", None), ("3", "nan?")], "a string, b string")
    got = {r.column: (r.n_values, r.n_rejected) for r in Q.cast_audit(df, {"a": "bigint", "b": "double"}).collect()}
    assert got == {"a": (3, 1), "b": (2, 1)}


def test_scores_file_roundtrip(spark, tmp_path):
    df = spark.range(166).select(F.col("id").cast("int").alias("Box"), (F.col("id") % 3).cast("int").alias("pred"))
    out = str(tmp_path / "scores")
    CSV.write_scores(df.repartition(4), out, single_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(out, files[0])) as f:
        text = f.read()
    assert text.startswith("0,0\n1,1\n2,2\n3,0\n") and text.endswith("165,0\n") and text.count("\n") == 166
    back = CSV.read_scores(spark, out)
    assert back.count() == 166 and back.dtypes == [("Box", "int"), ("pred", "int")]


def test_preview_limits_records(spark, tmp_path):
    p = str(tmp_path / "pv" / "x.csv")
    write_lines(p, ["a,b"] + [f"{i},{i}" for i in range(20)])
    assert CSV.read_csv(spark, p, "a int, b int", preview=5).count() == 5


def test_schema_report(spark):
    from georisk.operators import profile as P
    df = spark.createDataFrame([(1, "x")], "Count long, Box string")
    rows = P.schema_report(spark, df).collect()
    assert [(r.column, r.type) for r in rows] == [("Count", "bigint"), ("Box", "string")]


def test_schema_profile(spark):
    from georisk.operators import profile as P
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "Count long, `a.b` string, Box int")
    want = [(0, "Count", "bigint", 2, 0), (1, "a.b", "string", 2, 1), (2, "Box", "int", 2, 2)]
    assert sorted(map(tuple, P.schema_profile(df).collect())) == want
    assert sorted(map(tuple, P.schema_profile(df.limit(0)).collect())) == [(i, c, t, 0, 0) for i, c, t, _, _ in want]


def test_field_count_equals_split(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(['a', ',', '""', '"x,y"', ' ', 'q"', '"']), max_size=12), min_size=1, max_size=20))
    def check(parts):
        lines = ["".join(p) for p in parts]
        lines = [l for l in lines if l.count('"') % 2 == 0] or ["a,b"]
        df = spark.createDataFrame([(l,) for l in lines], "value string")
        got = df.select(Q.fields_outside_quotes(F.col("value")).alias("a"),
                        F.size(CSV.split_fields(F.col("value"))).alias("b")).collect()
        assert all(r.a == r.b for r in got)
    check()


def test_profile_sets_reproduce_direct_profiles(spark):
    from georisk.operators import profile as P
    from georisk.plans import inspect as I
    inc = incidents_from_tables(spark, SF001)
    plan = P.profile_sets(incidents_from_tables(spark, SF001, keep_out_of_bounds=True))
    text = I.plan_text(plan, "simple")
    assert text.count("lineitem.parquet") == 1 and I.count_exchanges(plan) == 1
    sets = plan.cache()
    overall = P.profile_part(sets, [])
    assert overall.select("min_x", "max_x", "min_y", "max_y").first() == P.profile_extent(inc).first()
    assert overall.select("min_ts", "max_ts").first() == P.profile_time(inc).first()
    assert overall.select(*P.profile_ranges(inc).columns).first() == P.profile_ranges(inc).first()
    assert sorted(P.profile_part(sets, ["DayOfWeek"]).select("DayOfWeek", "n").collect()) == sorted(P.count_by(inc, "DayOfWeek").collect())
    assert P.box_date_stats(P.profile_part(sets, ["Box", "Date"])).first() == P.box_date_stats(P.box_date_counts(inc)).first()
    a, b = P.sets_cells(sets), C.box_agg(inc)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    sets.unpersist()


def test_verbatim_split_reproduces_published_parsed_rows(spark):
    # the published run printed each parsed row joined with ';' (quotes kept)
    want = [
        '150470464;OTHER OFFENSES;"DRIVERS LICENSE, SUSPENDED OR REVOKED";Friday;05/29/2015;23:40;MISSION;'
        '"ARREST, BOOKED";19TH ST / SHOTWELL ST;-122.415929849548;37.7604330003754;'
        '"(37.7604330003754, -122.415929849548)";15047046465016',
        '150470420;NON-CRIMINAL;"AIDED CASE, MENTAL DISTURBED";Friday;05/29/2015;23:36;INGLESIDE;NONE;'
        '4900 Block of MISSION ST;-122.438695075365;37.7196920262929;"(37.7196920262929, -122.438695075365)";'
        '15047042064020',
        '150470680;LARCENY/THEFT;GRAND THEFT PICKPOCKET;Friday;05/29/2015;23:30;NORTHERN;NONE;'
        '1200 Block of POLK ST;-122.420326993863;37.7884521578132;"(37.7884521578132, -122.420326993863)";'
        '15047068006113',
    ]
    lines = spark.createDataFrame([(HEADER,)] + [(l,) for l in README_LINES], "value string")
    fields = CSV.split_verbatim(lines)
    got = [r.s for r in fields.select(F.concat_ws(";", *CSV.RAW_COLUMNS).alias("s")).collect()]
    assert got == want


@pytest.mark.parametrize("verbatim", [False, True])
def test_wrong_field_counts_fail_strict_and_drop_lenient(spark, tmp_path, verbatim):
    short = "150470999,OTHER OFFENSES"
    long = README_LINES[2] + ",extra"
    p = str(tmp_path / f"fc{int(verbatim)}" / "rows.csv")
    write_lines(p, [HEADER, README_LINES[0], short, long, README_LINES[1]])
    got = CSV.read_incidents_csv(spark, p, verbatim=verbatim, lenient=True).collect()
    assert sorted(r.Box for r in got) == [22, 100]
    with pytest.raises(Exception):
        CSV.read_incidents_csv(spark, p, verbatim=verbatim).collect()


CUT = ",".join(README_LINES[0].split(",")[:-2])


@pytest.mark.parametrize("verbatim", [False, True])
@pytest.mark.parametrize("wrong", [CUT, README_LINES[0] + ",extra", README_LINES[0].replace("150470464", "id"),
                                   README_LINES[0].replace("-122.4159", "west"), README_LINES[0].replace("05/29/2015", "13/45/2015"),
                                   README_LINES[0].replace("23:40", "")])
def test_the_answer_does_not_depend_on_the_projection(spark, tmp_path, verbatim, wrong):
    p = str(tmp_path / "w" / "rows.csv")
    write_lines(p, [HEADER, wrong, README_LINES[1], README_LINES[2]])
    kept = CSV.read_incidents_csv(spark, p, verbatim=verbatim, lenient=True)
    assert kept.count() == len(kept.collect()) == C.box_agg(kept).agg(F.sum("Count")).first()[0] == 2
    strict = CSV.read_incidents_csv(spark, p, verbatim=verbatim)
    for read in (strict.count, strict.collect, C.box_agg(strict).collect, strict.select("Category").collect):
        with pytest.raises(Exception, match="malformed"):
            read()


def test_well_formed_records_are_not_malformed(spark, tmp_path):
    p = str(tmp_path / "m" / "x.csv")
    write_lines(p, ['1,"a\nb",x', '2,"say ""hi"", then\n\ngo",y', '3,,', '4,only', '5,a,b,c'])
    got = {r.status: r.n for r in Q.malformed_records(spark, p, 3).collect()}
    assert got == {"OK": 3, "TooFewFields": 1, "TooManyFields": 1}


def test_files_are_cut_by_rows(spark, tmp_path):
    out = str(tmp_path / "cut")
    CSV.write_csv(spark.range(100).coalesce(1), out, rows_per_file=30)
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 4
    assert CSV.read_csv(spark, out, "id bigint").count() == 100


@pytest.mark.parametrize("verbatim", [False, True])
def test_each_record_is_split_and_parsed_once(spark, tmp_path, verbatim):
    path = tmp_path / "export.csv"
    path.write_text('1,A,"B, C",Friday,05/29/2015,23:30,D,E,F,-122.4,37.75,"(37.75, -122.4)",9\n'
                    '2,A,"B",Friday,13/45/2015,23:30,D,E,F,-122.4,37.75,"(37.75, -122.4)",9\n')
    df = CSV.read_incidents_csv(spark, str(path), verbatim=verbatim, lenient=True, header=False)
    assert [(r.IncidntNum, r.Timestamp.hour, r.X) for r in df.collect()] == [(1, 23, -122.4)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_join(") == verbatim
    assert plan.count('split(value') == verbatim
    assert plan.count("as bigint") == 1
    assert plan.count("gettimestamp(") == 2  # whether it is one, and its value


def test_lenient_counts_write_one_export(spark, monkeypatch):
    from georisk import queries as Q
    seen, export = [], Q._export_defects
    monkeypatch.setattr(Q, "_export_defects", lambda *a: seen.append(a) or export(*a))
    rows = Q.QUERIES["csv_lenient_counts"](spark, SF0001).collect()
    assert len(seen) == 1 and len(rows) == 2 and len({tuple(r)[1:] for r in rows}) == 1
