from collections import Counter

from pyspark.sql import functions as F

from georisk.llm import sharding as S
from georisk.llm.common import table, written
from tests.llm.texts import awkward, documents

SF0001 = "/root/testdata/sf0.001"


def sharded(spark, rows, shards=8):
    docs = documents(spark, rows).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("hub"))
    return S.shard_rows(written(docs, "t"), shards).collect()


def check(rows, got, shards=8):
    assert sorted((r.doc_id, r.hub) for r in got if r.doc_id is not None) == sorted((i, t or "") for i, t, _ in rows if i is not None)
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def off(got):
    """Linked documents that are not in their group's main shard."""
    groups = {}
    for r in got:
        groups.setdefault(r.hub, []).append(r.shard)
    return sum(len(g) - max(Counter(g).values()) for g in groups.values())


def test_groups_meet_and_sizes_stay_even(spark):
    rows = [(i, f"text {i % 40 if i < 160 else i}", "en") for i in range(803)]
    got = sharded(spark, rows)
    check(rows, got)
    assert off(got) == 0


def test_a_group_larger_than_shards_is_split(spark):
    rows = [(i, "hot" if i < 300 else f"t{i}", "en") for i in range(600)]
    got = sharded(spark, rows)
    check(rows, got)
    assert len({r.shard for r in got if r.hub == "hot"}) <= 6  # four shards could hold it


def test_all_linked(spark):
    rows = [(i, f"g{i % 5}", "en") for i in range(103)]
    check(rows, sharded(spark, rows))


def test_most_rows_linked_in_pairs(spark):
    for n, linked in ((20000, 20000), (20000, 18000)):
        rows = [(i, f"pair {i // 2}" if i < linked else f"alone {i}", "en") for i in range(n)]
        got = sharded(spark, rows)
        check(rows, got)
        assert off(got) <= 16  # the groups at the edges of eight shards


def test_admission_counts_departures():
    assert S.admissible([[0, 5], [4, 0]], [0, 0]) == [[0, 4], [4, 0]]
    assert S.admissible([[0, 5], [4, 0]], [0, 1]) == [[0, 5], [4, 0]]
    assert S.admissible([[0, 3, 0], [0, 0, 3], [2, 0, 0]], [0, 0, 0]) == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]
    assert S.admissible([[0, 3], [0, 0]], [4, -2]) == [[0, 0], [0, 0]]


def test_awkward_rows(spark):
    check(awkward(), sharded(spark, awkward()))
    assert sharded(spark, []) == []
    check([(1, "a", "en"), (2, "a", "en")], sharded(spark, [(1, "a", "en"), (2, "a", "en")]))


def test_query(spark):
    import zlib
    got = {r.doc_id: r for r in S.op4_sharding(spark, SF0001).collect()}
    docs = table(spark, SF0001, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_numbering_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "NUMBERED_ROWS", 10)
    df = spark.range(500).select(F.col("id").alias("uid"), (F.col("id") % 3).alias("g"))
    got = S.numbered(df, ["g"], 500).collect()
    for g in range(3):
        assert sorted(r.at for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))
