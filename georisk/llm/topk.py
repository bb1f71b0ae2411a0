"""Exact top-k search by inner product, in tiles.

Rows are hashed into shards and queries into blocks of bounded size; every
(shard, block) tile is one matrix product that keeps its best k per query, and
the per-query lists are merged as a tree, ``FAN_IN`` shards at a time. Products
are of integers and exact: in doubles while sums stay below 2**53, else in
64-bit or unbounded integers.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, nor does a row without an id; vectors meet only vectors of their
own length; ties go to the smaller id; a row repeated with the same id and
vector is dealt once, with its count (so a repeated row fills no tile), but takes
as many places in a list as it has rows; a repeated query gets its list as often;
rows that share the query's id are the query's own;
scores beyond 64 bits saturate; no query or no candidate -> no rows for it;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from georisk.llm.common import table

SHARD_ROWS = 16384
BLOCK_ROWS = 4096
FAN_IN = 16
LOWEST = np.iinfo(np.int64).min


def quantised(vector: str, scale: int = 1024) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = max(1, q.shape[1]) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0))
    if top < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if top < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, LOWEST + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best; columns are in order of id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > LOWEST))
    else:
        row, col = np.nonzero(scores > LOWEST)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def places(row: np.ndarray, col: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k places of each row, where column c takes ``n[c]`` of them."""
    times = np.minimum(n[col], k)
    row, col = np.repeat(row, times), np.repeat(col, times)
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def dealt(candidates: DataFrame, queries: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Candidates and queries with the shard and block of each of their tiles, and the number of shards."""
    def keyed(df):
        # Counted before anything else, partly before the shuffle: no tile gets a repeated row.
        rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"), F.col(vector).alias("v"))
        return rows.agg(F.count(F.lit(1)).alias("n")).select("id", "v", "n", F.size("v").alias("dim"), F.xxhash64("v").alias("h"))

    cand, query = keyed(candidates), keyed(queries)
    shards = max(1, -(-cand.count() // SHARD_ROWS))
    blocks = max(1, -(-query.count() // BLOCK_ROWS))
    spread = F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int")
    cand = cand.withColumn("shard", spread).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    query = query.withColumn("block", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return cand, query, shards


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score); ``vector`` columns are arrays of bigint."""
    cand, query, shards = dealt(candidates, queries, key, vector)
    tile = ["dim", "shard", "block"]
    schema = "query_id bigint, qh bigint, qn bigint, shard int, vec_id bigint, score bigint"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            dim, shard = left["dim"][0].as_py(), left["shard"][0].as_py()

            def by_id(t):
                ids, h, n = t["id"].to_numpy(), t["h"].to_numpy(), t["n"].to_numpy()
                order = np.lexsort((h, ids))
                return ids[order], h[order], n[order], _matrix(t, dim)[order] if dim else np.zeros((len(ids), 0), np.int64)

            ids, _, n, c = by_id(left)
            qids, qh, qn, q = by_id(right)
            for at in range(0, len(qids), 128):
                s = products(q[at: at + 128], c)
                s[qids[at: at + 128, None] == ids[None, :]] = LOWEST
                row, col = places(*best(s, ids, k), n, k)
                for col_out, v in zip(out, (qids[at + row], qh[at + row], qn[at + row], np.full(len(row), shard), ids[col], s[row, col])):
                    col_out.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for c, t in zip(out, kinds)]
        return pa.Table.from_arrays(cols, names=["query_id", "qh", "qn", "shard", "vec_id", "score"])

    found = cand.groupBy(*tile).cogroup(query.groupBy(*tile)).applyInArrow(run, schema)
    while True:
        shards = -(-shards // FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        order = Window.partitionBy("query_id", "qh", "shard").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            each = found.withColumn("__twin", F.explode(F.array_repeat(F.lit(0), F.col("qn").cast("int"))))
            return each.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


def op5_exact_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding")).select("vec_id", quantised("embedding").alias("v"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024e0 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""
