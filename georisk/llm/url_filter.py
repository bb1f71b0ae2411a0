"""URL filtering by rules and link-graph propagation, with DataFrame operations only.

A page's verdict is that of the longest rule that fits its host (or a domain
above it) and the start of its path. Other pages follow their host: personalised
PageRank spreads trust from hosts of allowed pages along host edges, and distrust
from hosts of blocked pages against them; a host is blocked when its distrust
exceeds ``threshold`` times its trust. Host edges are hyperlinks between hosts
and the steps between a host and the domain above it. Ranks are integers, so
sums do not depend on the order of rows and a retried task gives the same bits.
Shares are rounded up, so every host that a seed reaches has a rank, and ranks only
grow. Verdicts are those after ``ROUNDS`` rounds, when at most 0.85**(ROUNDS + 1) of
a side's MASS (below one part in 200) is still to be handed out, or after as many more as
it takes until no further host is reached. Rounds end sooner once that rest, all
given to one host, could change no verdict. ``STEP`` rounds make one plan: the ranks
are the only thing that is exchanged in each; neighbours are exchanged once.

Defined cases: a null url, or one without ``://``, has an empty host and path; a
host that no seed reaches is allowed; null html has no links; repeated rows and
null ids are rows like any other; no seeds at all -> all other pages allowed;
empty input -> empty output; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georisk.llm.common import table, written
from georisk.llm.components import HUB_LEAST, HUB_SHARE, hub_join

ALLOW, BLOCK = "allow", "block"
#: Rank is handed out in units of one in MASS.
MASS = 10**15
DAMPING = 85
ROUNDS = 32
#: Rounds of one plan, after which ranks are written and looked at.
STEP = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>\\]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The production rules.
RULES = [Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"),
         Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/")]


def lowered(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    return lowered(F.regexp_extract(u, PARTS, 1)), F.regexp_extract(u, PARTS, 2)


def judged(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and judged (the rule's verdict), the last two null without a rule."""
    host, path = host_and_path(url)
    out = pages.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("judged", verdict)


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct (src, dst) host edges of pages with a ``host`` column."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lowered))
    linked = written(pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).distinct(), "url-links")
    hosts = pages.select("host").distinct().unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda i: F.when(
            F.size(labels) - i >= 2, F.struct(
                F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("low"),
                F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("high"))))).alias("s")).select("s.low", "s.high")
    steps = above.where(F.col("low").isNotNull())
    both = steps.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(
        steps.select(F.col("high").alias("src"), F.col("low").alias("dst")))
    return linked.unionByName(both).where("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, threshold: int = 1, rounds: int = ROUNDS, early: bool = True) -> DataFrame:
    """(side, host, rank): side 't' along the edges, 'd' against them.
    ``seeds`` has (side, host, pages); each side's seeds share MASS by their pages. With
    ``early``, rounds end once no host's verdict for ``threshold`` can change any more."""
    def key(side, host):
        return F.concat(side, F.lit(" "), host)

    arrows = edges.select(key(F.lit("t"), F.col("src")).alias("k"), key(F.lit("t"), F.col("dst")).alias("to")).unionByName(
        edges.select(key(F.lit("d"), F.col("dst")).alias("k"), key(F.lit("d"), F.col("src")).alias("to")))
    arrows = written(arrows, "url-arrows")
    n = arrows.count()
    least = max(HUB_LEAST, n // HUB_SHARE)
    hubs = written(arrows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least), "url-hubs")
    some_hubs = not hubs.isEmpty()
    # Hosts with few neighbours carry them as one list of at most ``least``; a hub's arrows stay rows.
    cold = arrows.join(F.broadcast(hubs.select("k")), "k", "left_anti") if some_hubs else arrows
    near = written(cold.groupBy("k").agg(F.collect_list("to").alias("near")), "url-near")
    shares = seeds.groupBy("side").agg(F.sum("pages").alias("all"))  # two rows
    own = written(seeds.join(F.broadcast(shares), "side").select(key("side", "host").alias("k"), F.expr(
        f"CAST(CAST(pages AS DECIMAL(38,0)) * {MASS} DIV all AS BIGINT) * {100 - DAMPING} DIV 100").alias("rank"),
        F.lit(0).alias("far")), "url-seeds")

    def share(n):
        return F.expr(f"(rank * {DAMPING} + 100 * {n} - 1) DIV (100 * {n})").alias("rank"), (F.col("far") + 1).alias("far")

    def step(rank):
        given = rank.join(near, "k").select(F.explode("near").alias("k"), *share("size(near)"))
        if some_hubs:  # at most HUB_SHARE rows, wherever ranks lie
            high = rank.join(F.broadcast(hubs), "k").select("k", *share("n"))
            given = given.unionByName(arrows.join(F.broadcast(high), "k").select(F.col("to").alias("k"), "rank", "far"))
        return given.unionByName(own).groupBy("k").agg(F.sum("rank").alias("rank"), F.min("far").alias("far"))

    rank, done = own, 0
    while True:
        for _ in range(1 if some_hubs else min(STEP, max(rounds - done, 1))):
            rank, done = step(rank), done + 1
        rank = written(rank, "url-rank")
        if done % STEP and done < rounds:
            continue
        rest = MASS * DAMPING ** (done + 1) // 100 ** (done + 1) + 7 * n + 1  # all that can still be added, rounding up included
        sides = rank.groupBy(F.substring("k", 3, 1 << 30)).agg(
            F.sum(F.when(F.col("k").startswith("t"), F.col("rank"))).alias("t"),
            F.sum(F.when(F.col("k").startswith("d"), F.col("rank"))).alias("d"), F.max("far").alias("far"))
        open_ = (F.col("d") <= threshold * (F.col("t") + rest)) & (F.col("d") + rest > threshold * F.col("t"))
        seen = sides.agg(F.max("far").alias("far"), F.count_if(open_).alias("open")).first()
        closed = seen.far is None or seen.far < done  # nobody was reached by the last round
        if closed and (done >= rounds or early and not seen.open):
            return rank.select(F.substring("k", 1, 1).alias("side"), F.substring("k", 3, 1 << 30).alias("host"), "rank")


def filter_pages(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html",
                 threshold: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(key, host, path, rule, verdict) of every page."""
    told = judged(pages.select(key, url), rules, url).select(key, "host", "path", "rule", "judged")
    with_html = pages.select(host_and_path(url)[0].alias("host"), html)
    seeds = told.where("judged IS NOT NULL AND host <> ''").groupBy(
        F.when(F.col("judged") == ALLOW, "t").otherwise("d").alias("side"), "host").agg(F.count(F.lit(1)).alias("pages"))
    rank = propagate(host_edges(with_html, html), seeds, threshold, rounds).groupBy("host").agg(
        F.sum(F.when(F.col("side") == "t", F.col("rank")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("side") == "d", F.col("rank")).otherwise(0)).alias("distrust"))
    sizes = told.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    facts = written(sizes.join(rank, "host", "left").select("host", "n", (
        F.coalesce("distrust", F.lit(0)) > F.coalesce("trust", F.lit(0)) * threshold).alias("bad")), "url-hosts")
    total = facts.agg(F.sum("n")).first()[0] or 0
    return hub_join(told, facts, "host", "n", total).select(
        key, "host", "path", "rule", F.coalesce("judged", F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("verdict"))


def op9_url_filter(spark, sf_dir):
    return filter_pages(table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [(f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))", r)
            for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))]
    rule = " ".join(f"WHEN {c} THEN {q(r.text)}" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN {q(r.verdict)}" for c, r in fits)
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rounds = "".join(f""",
r{i + 1} AS MATERIALIZED (
  SELECT side, host, CAST(sum(rank) AS BIGINT) AS rank FROM (
    SELECT a.side, a.dst AS host, (r.rank * {DAMPING} + 100 * o.n - 1) // (100 * o.n) AS rank
    FROM r{i} r JOIN degree o ON o.side = r.side AND o.src = r.host JOIN arrows a ON a.side = r.side AND a.src = r.host
    UNION ALL SELECT side, host, rank FROM r0) GROUP BY side, host)""" for i in range(ROUNDS))
    return f"""
WITH p AS (
  SELECT page_id, html, {lower(f"regexp_extract(coalesce(url, ''), {q(PARTS)}, 1)")} AS host,
    regexp_extract(coalesce(url, ''), {q(PARTS)}, 2) AS path FROM pages),
told AS MATERIALIZED (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS judged FROM p),
linked AS (SELECT DISTINCT host AS src, {lower('l')} AS dst FROM (
  SELECT host, unnest(regexp_extract_all(html, {q(LINK)}, 1)) AS l FROM p)),
hosts AS (SELECT host FROM told UNION SELECT dst FROM linked),
above AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high FROM (
    SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts))),
edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, dst FROM linked UNION ALL SELECT low, high FROM above UNION ALL SELECT high, low FROM above)
  WHERE src <> '' AND dst <> '' AND src <> dst),
arrows AS MATERIALIZED (SELECT 't' AS side, src, dst FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
degree AS MATERIALIZED (SELECT side, src, count(*) AS n FROM arrows GROUP BY side, src),
seeded AS (
  SELECT CASE judged WHEN '{ALLOW}' THEN 't' ELSE 'd' END AS side, host, count(*) AS pages
  FROM told WHERE judged IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS MATERIALIZED (
  SELECT side, host, CAST(CAST(pages AS HUGEINT) * {MASS} // sum(pages) OVER (PARTITION BY side) AS BIGINT) AS seed FROM seeded),
r0 AS MATERIALIZED (SELECT side, host, seed * {100 - DAMPING} // 100 AS rank FROM seeds){rounds},
bad AS (
  SELECT host FROM r{ROUNDS} GROUP BY host
  HAVING coalesce(sum(rank) FILTER (WHERE side = 'd'), 0) > coalesce(sum(rank) FILTER (WHERE side = 't'), 0))
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN host IN (SELECT host FROM bad) THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
FROM told"""


OP9_SQL = _sql()
