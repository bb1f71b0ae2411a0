"""Sharding by balanced label propagation, with DataFrame operations only.

Documents are linked through hubs (here: equal texts), so a group of any size is
a star and never all pairs. Linked documents start in a hashed shard. In each
round the votes of every hub's members are counted per shard, each document asks
for the shard with most of its neighbours (unless that shard refused its group
before and still lacks room for the rest of it), and requests are admitted by
priority as far as the shard's quota goes, where room that others leave counts
as room. Quotas lie a little above capacity. In the end each shard takes at most
its capacity of linked documents, group by group; what is over stays together
and, with all documents without links, fills the remaining room. Under the law
``rows`` capacities differ by at most one, so counts do too. A group larger than
a shard is split, and so may be the groups at the edges of the shards.

Defined cases: null text counts as empty (size 1, checksum 0); null keys and
repeated rows are rows like any other; fewer rows than shards -> the first
shards get one each; empty input -> empty output; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from georisk.llm.common import table, written
from georisk.llm.components import hub_join

SHARDS = 8
ROUNDS = 8
#: Priorities of a shard's requests: hubs in 64 turns, members of one hub in 64 turns.
TURNS = 64
#: Rows that one numbering task handles on average.
NUMBERED_ROWS = 100_000


def _chain(pairs: list[tuple[Column, Column]], last: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), last)


def numbered(df: DataFrame, group: list[str], total: int, out: str = "at", hub: str | None = None) -> DataFrame:
    """A gapless number from 0 per group. Rows are counted in hashed buckets first,
    so no task sees a whole group. With ``hub``, rows of one hub follow each other;
    the column ``many`` counts them (both null for rows without), and a hub of more
    rows than a bucket is dealt over several."""
    buckets = max(1, total // NUMBERED_ROWS)
    first = F.xxhash64("uid", F.lit(1))
    part = F.lit(0)
    if hub:
        first = F.when(F.col("many").isNotNull(), F.xxhash64(hub, F.lit(1))).otherwise(first)
        part = F.pmod(F.xxhash64("uid", F.lit(3)), F.coalesce(F.ceil(F.col("many") / NUMBERED_ROWS), F.lit(1)))
    placed = df.withColumn("__h", first).withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int")).withColumn(
        "__p", part.cast("int"))
    counts = placed.groupBy(*group, "__b", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b", "__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__b", "__p").orderBy("__h", F.xxhash64("uid"), "uid")
    ranked = placed.withColumn("__r", F.row_number().over(inside))
    return ranked.join(offsets, [*group, "__b", "__p"]).withColumn(
        out, (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__h", "__b", "__p", "__before", "__r")


def _per_shard(df: DataFrame, shard: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(shard).count().collect()}  # one row per shard
    return [found.get(s, 0) for s in range(shards)]


def admissible(asks: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``asks[a][b]`` rows may go from shard a to b, so that no shard
    gets more than its room and the rows that leave it. What is too much for a shard
    is taken back along the moves into it, the shortest way to a shard with room."""
    moves = [list(row) for row in asks]
    left = [r + sum(moves[s]) - sum(row[s] for row in moves) for s, r in enumerate(room)]
    for s in range(len(room)):
        while left[s] < 0:
            after, reached = {s: None}, [s]
            for b in reached:
                for a in range(len(room)):
                    if moves[a][b] > 0 and a not in after:
                        after[a] = b
                        reached.append(a)
            end = next((t for t in reached if left[t] > 0), None)
            if end is None:  # too full before any move
                break
            path, a = [], end
            while a != s:
                path.append((a, after[a]))
                a = after[a]
            back = min(-left[s], left[end], *(moves[a][b] for a, b in path))
            for a, b in path:
                moves[a][b] -= back
            left[s] += back
            left[end] -= back
    return moves


def propagate(members: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(uid, shard) of the linked nodes ``members`` (uid, hub), a node in one or more hubs.
    Shards may end up above capacity by their slack, or as the hashes left them."""
    shards = len(capacity)
    links = members.count()
    state = written(members.select("uid").distinct().withColumn(
        "shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).withColumn("refused", F.lit(0)), "shard-state")
    votes = [f"v{s}" for s in range(shards)]
    # Slack for what chance makes of asks in both directions.
    quota = [c + c // 64 + 2 * isqrt(c) for c in capacity]
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, _per_shard(state, "shard", shards))]
        now = members.join(state, "uid")
        facts = now.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.bit_or("refused").alias("shut"), *[
            F.count_if(F.col("shard") == s).alias(v) for s, v in enumerate(votes)])
        heard = hub_join(now, facts, "hub", "n", links).groupBy("uid", "shard").agg(
            F.min("hub").alias("hub"), F.bit_or("shut").alias("shut"), *[F.sum(v).alias(v) for v in votes])
        # Most neighbours first (the document itself included), then a shard that did not refuse the
        # group, then the order that its hub gives, so that members who see the same votes agree.
        # A shard that refused some of a group is asked again once the rest of the group fits.
        near = reduce(lambda a, b: a + b, [F.col(v) for v in votes])
        free = [(F.col("shut").bitwiseAND(F.lit(1 << s)) == 0) | (near - F.col(v) <= room[s]) for s, v in enumerate(votes)]
        offers = [F.when((F.col("shard") == s) | f, F.array(
            F.col(v), f.cast("long"), F.pmod(F.xxhash64("hub", F.lit(s)), F.lit(1 << 30)), F.lit(s).cast("long")))
            for s, (v, f) in enumerate(zip(votes, free))]
        wish = F.array_max(F.filter(F.array(*offers), lambda x: x.isNotNull()))[3].cast("int")
        turn = F.pmod(F.xxhash64("hub"), F.lit(TURNS)) * TURNS + F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(TURNS))
        asked = written(heard.select("uid", "shard", "shut", wish.alias("to"), turn.cast("int").alias("turn")), "shard-asked")
        asks = [[0] * shards for _ in range(shards)]
        for a, b, n in asked.where("to <> shard").groupBy("shard", "to").count().collect():  # at most shards**2 rows
            asks[a][b] = n
        limits = F.array(*[F.lit(n).cast("long") for row in admissible(asks, room) for n in row])
        queue = Window.partitionBy("shard", "to").orderBy("turn")
        # At most (shards * TURNS)**2 rows: small enough to broadcast whatever the input.
        admitted = asked.where("to <> shard").groupBy("shard", "to", "turn").count().withColumn(
            "upto", F.sum("count").over(queue)).where(F.col("upto") <= limits[F.col("shard") * shards + F.col("to")]).select(
            "shard", "to", "turn", F.lit(True).alias("ok"))
        moves = F.coalesce("ok", F.lit(False))
        state = written(asked.join(F.broadcast(admitted), ["shard", "to", "turn"], "left").select(
            "uid", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"),
            F.when(moves | (F.col("to") == F.col("shard")), F.col("shut")).otherwise(
                F.col("shut").bitwiseOR(F.expr("shiftleft(1, to)"))).alias("refused"),
            (F.col("to") != F.col("shard")).alias("asked")), "shard-state")
        more = state.where("asked").limit(1).count()
        state = state.select("uid", "shard", "refused")
        if not more:
            break
    return state.select("uid", "shard")


def shard_rows(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (uid, hub, ...) plus shard and slot, counts at most one apart.
    ``uid`` must be unique and stable; ``hub`` may be null for unlinked nodes."""
    total = nodes.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    hubs = nodes.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn(
        "many", F.col("n"))
    members = written(hub_join(nodes.select("uid", "hub"), hubs, "hub", "n", total), "shard-members")
    placed = propagate(members.select("uid", "hub"), capacity, rounds).join(members, "uid")
    linked = written(numbered(placed, ["shard"], total, hub="hub"), "shard-linked")
    cap = _chain([(F.col("shard") == s, F.lit(c)) for s, c in enumerate(capacity)], F.lit(0))
    stays = linked.where(F.col("at") < cap)
    kept = _per_shard(stays, "shard", shards)
    over = linked.where(F.col("at") >= cap).select("uid", "many")
    rest = nodes.join(stays, "uid", "left_anti").join(over, "uid", "left").withColumn("__all", F.lit(0))
    cuts = [sum(c - k for c, k in zip(capacity[:s], kept[:s])) for s in range(shards)]
    at = F.col("at")
    shard = _chain([(at >= cuts[s], F.lit(s)) for s in range(shards - 1, 0, -1)], F.lit(0))
    slot = _chain([(at >= cuts[s], at - cuts[s] + kept[s]) for s in range(shards - 1, 0, -1)], at + kept[0])
    filled = numbered(rest, ["__all"], total, hub="hub").withColumn("slot", slot).withColumn("shard", shard).drop("at", "__all")
    return nodes.join(stays.select("uid", "shard", F.col("at").alias("slot")), "uid").unionByName(filled.select(
        *nodes.columns, "shard", "slot"))


def op4_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
    found = shard_rows(written(docs, "shard-nodes"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
