"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family for radius r over 64 bits: each bit position gets a non-zero
vector of r + 1 bits, and table v (each non-zero vector) keeps the positions
whose vector has an odd product with v. Any r positions span at most r
dimensions, so some v is orthogonal to all of them: two fingerprints at r or
fewer differing bits agree on that table's mask and meet there. No link is missed.

Only distinct fingerprints are bucketed. A bucket of two is one comparison; a
larger one is cut into blocks by hash, each pair of blocks is a tile, and a tile
yields a star for each group of linked fingerprints, never all pairs. A very large
bucket is first dealt to finer ones by a covering family over its free bits.
Components are found over those links.

Defined cases: null, empty or blank text -> fingerprint zero, linked like any
other; fewer words than the shingle -> the whole sequence is one shingle; a null
key gets its fingerprint and the smallest non-null key reachable (null if none);
repeated rows each come out; empty input -> empty output; other columns are not read.
"""

from __future__ import annotations

from itertools import islice
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.common import content_hash, map_texts, table, written
from georisk.llm.components import connected_components, hub_join

SEED = 42
BITS = 64
#: Fingerprints of a bucket that one block holds on average.
BLOCK = 1024
#: Beyond so many fingerprints a bucket is split by further bits before it is cut into tiles.
CROWDED = 16 * BLOCK
LONG_TEXT = 1 << 22
CHUNK = 1 << 15


def _shingles(text: bytes, k: int):
    """Shingles of a text in lists of at most CHUNK."""
    if len(text) <= LONG_TEXT:
        words = iter(text.lower().split())
    else:
        words = (m[0].lower() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text))
    tail = list(islice(words, k - 1))
    if 0 < len(tail) < k - 1:
        yield [b" ".join(tail)]
        return
    first = True
    while True:
        run = tail + list(islice(words, CHUNK))
        if len(run) < k:
            if first and run:
                yield [b" ".join(run)]
            return
        yield list(map(b" ".join, zip(*[run[i:] for i in range(k)])))
        first, tail = False, run[len(run) - k + 1:]


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(df: DataFrame, keep: list[str], text: str, shingle: int, out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint (a signed long) of every row."""

    def make():
        digest = xxhash.xxh64_intdigest

        def fn(col: pa.Array):
            ones = np.zeros((len(col), BITS), np.int64)
            totals = np.zeros(len(col), np.int64)
            hashes, rows, starts = [], [], []

            def settle():
                if hashes:
                    np.add.at(ones, rows, np.add.reduceat(_bits(hashes), starts, axis=0, dtype=np.int32))
                    hashes.clear(), rows.clear(), starts.clear()

            for i, t in enumerate(col.cast(pa.large_binary()).to_pylist()):
                for part in _shingles(t or b"", shingle):
                    rows.append(i)
                    starts.append(len(hashes))
                    hashes.extend([digest(s, SEED) for s in part])
                    totals[i] += len(part)
                    if len(hashes) >= CHUNK:
                        settle()
            settle()
            words = np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little")
            return [np.ascontiguousarray(words).view("<i8").ravel()]

        return fn

    return map_texts(df, text, keep, [(out, T.LongType())], make)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask (signed) per table; see the module's text."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [_signed(sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)) for v in range(1, 1 << (radius + 1))]


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Index pairs (first member found, other) that connect all links within the radius."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                queue += found
                a += [root] * len(found)
                b += found
    return a, b


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` with each mask of a covering family over the bits it leaves free."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    family = covering_masks(radius, len(free))
    return [_signed((mask | sum(1 << free[i] for i in range(len(free)) if m >> i & 1)) & (1 << BITS) - 1) for m in family]


def _placed(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(t, k, fp): each fingerprint in the bucket it has in each table (t, mask)."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in masks])
    return fps.select("fp", F.explode(tables).alias("b")).select("b.t", "b.k", "fp")


def _buckets(placed: DataFrame) -> DataFrame:
    found = placed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    return written(found.where("n > 1"), "simhash-buckets")


def _tiled(placed: DataFrame, buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius in the same bucket."""
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    crowded = buckets.where("n > 2").select("t", "k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = placed.join(crowded, ["t", "k"]).withColumn("x", block).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.groupBy("t", "k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(
        F.collect_list("fp").alias("fps"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                v = row.values.to_numpy()
                i, j = forest(v, radius)
                if i:
                    a.append(v[i])
                    b.append(v[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    return pairs.unionByName(tiles.select("fps").mapInArrow(run, "a bigint, b bigint"))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius.

    A bucket of more than ``CROWDED`` fingerprints is dealt to finer buckets first, by a
    covering family over the bits that its own mask leaves free."""
    masks = list(enumerate(covering_masks(radius)))
    placed = _placed(fps, masks)
    buckets = _buckets(placed)
    found = _tiled(placed, buckets.where(F.col("n") <= CROWDED), radius)
    crowded = buckets.where(F.col("n") > CROWDED).select("t", "k")
    if not crowded.isEmpty():
        finer = {t: finer_masks(m, radius) for t, m in masks}
        width = len(masks)
        deep = written(placed.join(crowded, ["t", "k"]).select("t", "fp"), "simhash-crowded")
        tables = F.element_at(F.create_map(*[c for t, ms in finer.items() for c in (F.lit(t), F.array(*[F.struct(
            F.lit((t + 1) * width + w).alias("t"), F.lit(m).alias("m")) for w, m in enumerate(ms)]))]), F.col("t"))
        deep = deep.select("fp", F.explode(tables).alias("b")).select(
            F.col("b.t").alias("t"), F.col("fp").bitwiseAND(F.col("b.m")).alias("k"), "fp")
        found = found.unionByName(_tiled(deep, _buckets(deep), radius))
    return found


def groups(docs: DataFrame, radius: int) -> DataFrame:
    """(fp, n, root, component) of each distinct fingerprint of ``docs`` (key, fp): its
    number of rows, its group's smallest fingerprint and smallest key."""
    classes = written(docs.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    comp = connected_components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    found = written(classes.join(comp, "fp", "left"), "simhash-rooted")
    alone = found.where("root IS NULL").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component"))
    linked = found.where("root IS NOT NULL")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("size"))
    joined = hub_join(linked, roots, "root", "size", found.count()).select("fp", "n", "root", "component")
    return written(alone.unionByName(joined), "simhash-facts")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component) of every row; the component is the smallest key reachable."""
    docs = written(fingerprints(df, [key], text, shingle).withColumnRenamed(key, "key"), "simhash-docs")
    facts = groups(docs, radius).select("fp", "n", "component")
    return hub_join(docs, facts, "fp", "n", docs.count()).select(F.col("key").alias(key), "fp", "component")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df``, one of each group: the one with the smallest key, among rows of
    that key the one with the smallest content hash; a null key only if its group has no other."""
    marked = df.withColumn("__row", content_hash(df))
    docs = written(fingerprints(marked, [key, "__row"], text, shingle).withColumnRenamed(key, "key"), "simhash-docs")
    facts = groups(docs, radius).select("fp", "n", "root")
    ranked = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), F.col("__row").alias("row"))
    best = hub_join(docs, facts, "fp", "n", docs.count()).groupBy("root").agg(F.min(ranked).alias("b"))
    best = best.select(F.col("b.id").alias("__id"), F.col("b.row").alias("__row"))
    mine = marked[key].eqNullSafe(best["__id"]) & (marked["__row"] == best["__row"])
    return marked.join(best, mine, "left_semi").dropDuplicates([key, "__row"]).drop("__row")


def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
