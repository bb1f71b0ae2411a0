"""Joins that survive hub keys, and connected components by contraction and alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georisk.llm.common import written

#: A key is a hub beyond this share of all rows (and at least HUB_LEAST of them), so
#: there are at most HUB_SHARE hubs however large the input is: they can be broadcast.
HUB_SHARE = 1000
HUB_LEAST = 1000
#: Links that one task contracts at once, and about as many of them as one task is given.
TASK_LINKS = 250_000


def hub_join(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` per key.

    ``facts[n]`` counts the rows of each key, ``total`` all rows. Rows of hub keys
    stay where they are and meet their facts by broadcast; the others are shuffled.
    """
    least = max(HUB_LEAST, total // HUB_SHARE)
    extra = [c for c in facts.columns if c not in (key, n)]
    hubs = F.broadcast(facts.where(F.col(n) > least).select(key, *extra, F.lit(True).alias("__hub")))
    marked = rows.join(hubs, key, "left")
    rest = marked.where(F.col("__hub").isNull()).drop("__hub", *extra)
    cold = facts.where(F.col(n) <= least).select(key, *extra)
    return marked.where(F.col("__hub")).drop("__hub").unionByName(rest.join(cold, key))


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Both directions of ``edges`` (a, b), joined with the smallest neighbour of a."""
    facts = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return hub_join(edges, facts, "a", "n", total).withColumn("m", F.least("m", "a"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its component in the links a - b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        if (root[x] == root[y]).all():
            break
        for side in (x, y):  # the roots of both ends hook below the smaller one
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        while (root[root] != root).any():
            root = root[root]
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs, replaced in each task by stars that connect the same nodes."""
    def run(batches):
        held, size = [], 0

        def settled():
            node, root = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= TASK_LINKS:
                yield settled()
                held, size = [], 0
        if held:
            yield settled()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node points at several others, or at one that points on itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
                                          F.struct(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("to")))).alias("e"))
    seen = ends.select("e.*").groupBy("node").agg(F.min("to").alias("x"), F.max("to").alias("y"), F.count(F.lit(1)).alias("n"),
                                                  F.count("to").alias("out"))
    return not seen.where("out > 0 AND (x <> y OR n > out)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of longs; the root is the
    smallest node reachable.

    Links are contracted to stars where they arise, and once more in tasks of about
    ``TASK_LINKS`` of what that leaves. While tasks' stars still overlap, rounds of large-star
    and small-star shorten all paths; every round is written to the shared folder."""
    raw = written(contracted(edges), "cc-links")
    tasks = -(-raw.count() // TASK_LINKS)
    e = written(contracted(raw.coalesce(max(1, tasks))), "cc-edges")
    while _unsettled(e):
        n = e.count()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, "cc-large")
        linked = _star(large, n)
        small = linked.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = written(small.select("e.a", "e.b").where("a <> b").distinct(), "cc-small")
    e = e.distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
