import math
import random

import pytest
from pyspark.sql import functions as F

from georisk.llm import topk as K
from georisk.llm import url_filter as U


def brute(rows, k):
    good = [(i, tuple(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    ints = sorted((i, tuple(math.floor(1024 * x) for x in v)) for i, v in good)
    out = []
    for i, q in ints:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if j != i and len(c) == len(q))
            out += [(i, n + 1, j, min(-x, 2**63 - 1)) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(16384, 4096), (16, 2)])
def test_top_k_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(K, "SHARD_ROWS", shard)
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    monkeypatch.setattr(K, "FAN_IN", 3)
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(3)]) for i in range(350)]
    rows += [(400, None), (401, [0.5, None, 0.1]), (500, [0.1, float("nan"), 1.0]), (402, [float("inf")] * 3), (None, [1.0] * 3),
             (600, [1.0, 2.0]), (601, [3.0, 1.0]), (700, []), (701, []), rows[5], rows[100], *[rows[9]] * 7, (800, [1e6, 1e7, 3e6]), (801, [3e9, 2e9, 1e9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, dim int, h string").repartition(4)
    good = df.where(K.usable("embedding")).select("vec_id", K.quantised("embedding").alias("v"))
    got = K.top_k(good, good.where("vec_id % 100 = 0"), k=4)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 4)


def test_query_and_oracle_agree_on_repeated_rows(spark, tmp_path):
    import duckdb
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.25, 0.25]), (200, [0.0, 1.0]), (200, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(tuple(r) for r in K.op5_exact_top_k(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(K.OP5_SQL).fetchall()) == brute(rows, 10)
    assert [r[2] for r in got if r[0] == 100] == [200, 200, 1, 1, 1, 1, 200, 200, 2, 2]  # two lists, rank by rank


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, v array<bigint>")
    assert K.top_k(none, none).collect() == []


RULES = [U.Rule("allow", "net", "/"), U.Rule("block", "bad.net", "/x"), U.Rule("allow", "bad.net", "/x/y")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 5) for i, (u, h) in enumerate(rows)],
                                 "page_id bigint, url string, html string, rule string, rank int").repartition(3)


def link(*urls):
    return "".join(f'<a HREF = "{u}">x</a>' for u in urls)


def test_a_repeated_row_fills_no_tile(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 100)
    rows = [(i if i % 3 else 0, [i if i % 3 else 0, 1]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    cand, query, shards = K.dealt(df, df.where("vec_id % 100 = 0"), "vec_id", "v")
    assert shards == 11  # 1001 distinct rows
    for side in (cand, query):
        assert side.groupBy("dim", "shard", "block").count().agg({"count": "max"}).first()[0] <= 150


def test_rules_hosts_and_paths(spark):
    rows = [("http://A.Net/x?q", None), ("//a.net/x", ""), (None, "x"), ("s://bad.net/x/yz#f", ""), ("s://w.bad.net/x", ""),
            ("s://notbad.net", ""), ("s://éÉ.net?/x", ""), ("a://b://c/d", ""), ("http://h.org", ""), ("", ""), ("x\n://y.net/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_pages(pages(spark, rows), RULES).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("bad.net", "/x/yz", "bad.net/x/y", "allow"), 4: ("w.bad.net", "/x", "bad.net/x", "block"),
        5: ("notbad.net", "", None, "allow"), 6: ("éÉ.net", "", None, "allow"), 7: ("b:", "//c/d", None, "allow"),
        8: ("h.org", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("y.net", "/", "net/", "allow")}
    assert U.filter_pages(pages(spark, []), RULES).collect() == []


def test_trust_and_distrust_propagate(spark):
    rows = [("s://good.net/", link("http://friend.io/1", "//twin.io")), ("s://friend.io/", link("https://pal.io/x")),
            ("s://pal.io/", ""), ("s://bad.net/x", ""), ("s://shady.io/", link("http://bad.net/x")),
            ("s://worse.io/", link("http://SHADY.io")), ("s://alone.io/", "")]
    got = {r.host: r.verdict for r in U.filter_pages(pages(spark, rows), RULES).collect()}
    assert got == {"good.net": "allow", "friend.io": "allow", "pal.io": "allow", "bad.net": "block", "shady.io": "block",
                   "worse.io": "block", "alone.io": "allow"}


def test_a_long_chain_to_a_blocked_host(spark):
    rows = [("s://bad.net/x", ""), ("s://c0.io/", link("http://bad.net/x"))] + [
        (f"s://c{i}.io/", link(f"http://c{i - 1}.io")) for i in range(1, 44)] + [("s://alone.com/", "")]
    got = {r.host: r.verdict for r in U.filter_pages(pages(spark, rows), RULES).collect()}
    assert got == {f"c{i}.io": "block" for i in range(44)} | {"bad.net": "block", "alone.com": "allow"}


def plain_ranks(edges, seeds, rounds):
    """The rule in plain arithmetic, and the number of the last round that reached a further host."""
    want, last = {}, 0
    for side in "td":
        arrows = edges if side == "t" else [(b, a) for a, b in edges]
        total = sum(p for s, _, p in seeds if s == side)
        own = {h: p * U.MASS // total * (100 - U.DAMPING) // 100 for s, h, p in seeds if s == side}
        rank = dict(own)
        for done in range(rounds):
            new = dict(own)
            for a, b in arrows:
                if a in rank:
                    n = 100 * sum(x == a for x, _ in arrows)
                    new[b] = new.get(b, 0) + -(-rank[a] * U.DAMPING // n)
            last = max(last, done + 1 if new.keys() - rank.keys() else 0)
            rank = new
        want |= {(side, h): v for h, v in rank.items()}
    return want, last


def random_graph(seed, hosts, links):
    r = random.Random(seed)
    edges = {(f"h{r.randrange(hosts)}", f"h{r.randrange(hosts)}") for _ in range(links)}
    return sorted((a, b) for a, b in edges if a != b), [("t", "h1", 3), ("t", "h2", 1), ("d", "h5", 2), ("d", "h3", 2)]


def frames(spark, edges, seeds):
    return (spark.createDataFrame(edges, "src string, dst string"),
            spark.createDataFrame(seeds, "side string, host string, pages bigint"))


@pytest.mark.parametrize("hub", [1000, 3])
def test_ranks_against_plain_arithmetic(spark, monkeypatch, hub):
    monkeypatch.setattr(U, "HUB_LEAST", hub)
    edges, seeds = random_graph(4, 12, 40)
    got = U.propagate(*frames(spark, edges, seeds), rounds=11, early=False)
    want, last = plain_ranks(edges, seeds, 11)
    assert last < 11
    assert {(x.side, x.host): x["rank"] for x in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_an_early_end_changes_no_verdict(spark, seed):
    edges, seeds = random_graph(seed, 30, 60)

    def verdicts(ranks):
        return {h for _, h in ranks if ranks.get(("d", h), 0) > ranks.get(("t", h), 0)}

    got = {(x.side, x.host): x["rank"] for x in U.propagate(*frames(spark, edges, seeds)).collect()}
    assert verdicts(got) == verdicts(plain_ranks(edges, seeds, 90)[0])
