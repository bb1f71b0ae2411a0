"""Removal of repeated passages, found by difference-cover anchors.

A window is ``length`` consecutive words. A difference cover D modulo a period p
has, for any two starts i and j, a shift d < p with i + d and j + d both in D
modulo p. So hashing runs of ``length - p + 1`` words only at positions in D
makes any two equal windows share an aligned anchor. Anchors that occur in more
than one document are extended: every window that holds one is hashed whole
(128 bits), and a window is a repeat if its hash also starts in a document with
a smaller key. All work is linear in the repeated text; no pairs are formed. Of
documents with equal texts only the smallest is extended.

Defined cases: null text has no words; a null key is no document's smaller key
and loses nothing; rows with the same key are one document's parts for
comparison and come out one by one; texts shorter than a window lose nothing;
empty input -> empty output; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.common import WordHash, flat, slices, table, word_bounds, written
from georisk.llm.components import hub_join

LENGTH = 50
PERIOD = 31


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences give every residue."""
    size = 1
    while True:
        for rest in combinations(range(2, period), max(0, size - 2)):
            cover = [0, 1, *rest][:size]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


class Windows:
    """Word, anchor and window hashes of a slice of texts."""

    def __init__(self, length: int, period: int, cover: list[int]):
        self.length, self.anchor, self.period = length, length - period + 1, period
        self.at_cover = np.zeros(period, bool)
        self.at_cover[cover] = True
        self.one, self.two = WordHash(), WordHash(0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)

    def read(self, texts: pa.Array) -> None:
        data, offsets = flat(texts)
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        self.data, self.n_words = data, np.diff(self.first)
        self.words = self.one.words(data, self.starts, self.ends)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.n_words)  # in its text
        self.left = np.repeat(self.n_words, self.n_words) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indices of anchors and their hashes; texts without a window have none."""
        long = self.place + self.left >= self.length
        at = np.flatnonzero(self.at_cover[self.place % self.period] & (self.left >= self.anchor) & long)
        return at, self.one.windows(self.words, at, self.anchor)

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of all windows that hold one of the anchors whole."""
        hit = np.zeros(len(self.words) + 1, np.int64)
        low = np.maximum(anchors - (self.length - self.anchor), anchors - self.place[anchors])
        np.add.at(hit, low, 1)
        np.add.at(hit, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(hit)[:-1] > 0) & (self.left >= self.length))

    def hashes(self, at: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        a = self.one.windows(self.words, at, self.length)
        if not second:
            return a, None
        return a, self.two.windows(self.two.words(self.data, self.starts, self.ends), at, self.length)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def anchor_rows(docs: DataFrame, length: int, period: int, cover: list[int]) -> DataFrame:
    """(h, key), each once per slice."""

    def run(batches):
        w = Windows(length, period, cover)
        for b in batches:
            for part in slices(b, 1):
                w.read(part.column(1))
                at, h = w.anchors()
                seen = np.unique(np.stack([h, w.text_of(at).astype(np.uint64)]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [_signed(seen[0]), part.column(0).take(pa.array(seen[1].astype(np.int64)))], names=["h", "key"])

    return docs.select("key", "text").mapInArrow(run, "h bigint, key bigint")


def _members(lists: pa.ListArray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in its row's list (``of`` gives the row, ascending)."""
    out = np.zeros(len(values), bool)
    cuts = np.searchsorted(of, np.arange(len(lists) + 1))
    for i in range(len(lists)):
        s = slice(cuts[i], cuts[i + 1])
        if cuts[i] < cuts[i + 1] and lists[i].is_valid:
            out[s] = np.isin(values[s], lists[i].values.to_numpy().view(np.uint64))
    return out


def window_rows(docs: DataFrame, length: int, period: int, cover: list[int]) -> DataFrame:
    """(w1, w2, key) of the windows around the anchors listed in ``hs``."""

    def run(batches):
        w = Windows(length, period, cover)
        for b in batches:
            for part in slices(b, 1):
                w.read(part.column(1))
                at, h = w.anchors()
                at = w.around(at[_members(part.column(2), w.text_of(at), h)])
                h1, h2 = w.hashes(at)
                keys = part.column(0).take(pa.array(w.text_of(at)))
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), keys], names=["w1", "w2", "key"])

    return docs.select("key", "text", "hs").mapInArrow(run, "w1 bigint, w2 bigint, key bigint")


def kept_rows(docs: DataFrame, length: int, period: int, cover: list[int]) -> DataFrame:
    """Per row: number of words, number removed, the kept words joined by one blank.
    ``ws`` lists hashes of repeated windows; a ``copy`` loses all words if it has a window."""
    schema = T.StructType([docs.schema["key"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches):
        w = Windows(length, period, cover)
        for b in batches:
            for part in slices(b, 1):
                w.read(part.column(1))
                listed = part.column(2)
                whole = part.column(3).to_numpy(False) & (w.n_words >= length)
                at = np.flatnonzero((w.left >= length) & np.repeat(listed.is_valid().to_numpy(False), w.n_words))
                h, _ = w.hashes(at, second=False)
                at = at[_members(listed, w.text_of(at), h)]
                gone = np.zeros(len(w.words) + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
                gone = (np.cumsum(gone)[:-1] > 0) | np.repeat(whole, w.n_words)
                raw, kept, removed = w.data.tobytes(), [], []
                for i in range(part.num_rows):
                    s = slice(w.first[i], w.first[i + 1])
                    k = ~gone[s]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(w.starts[s][k].tolist(), w.ends[s][k].tolist())]))
                    removed.append(int(len(k) - k.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(w.n_words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept"])

    return docs.select("key", "text", "ws", "copy").mapInArrow(run, schema)


def copies(known: DataFrame) -> DataFrame:
    """(key, digest) of documents whose whole text also is a document with a smaller key."""
    rows = written(known.select("key", "digest"), "dedup-digests")
    same = rows.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hub_join(rows, same, "digest", "n", rows.count()).where("key > least").select("key", "digest")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   period: int = PERIOD) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row."""
    shape = length, period, difference_cover(period)
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    known = docs.where("key IS NOT NULL AND text IS NOT NULL")
    # A copy's windows all start in the smallest document of the same text, which stands for it.
    copied = written(copies(known), "dedup-copies").groupBy("key").agg(F.collect_set("digest").alias("digests"))
    anchors = anchor_rows(known, *shape)
    shared = written(anchors.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h"),
                     "dedup-anchors")
    listed = anchors.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs")).join(copied, "key", "left")
    is_copy = F.coalesce(F.array_contains("digests", F.col("digest")), F.lit(False))
    windows = written(window_rows(known.join(listed, "key").where(~is_copy), *shape), "dedup-windows")
    first = windows.groupBy("w1", "w2").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    first = written(first.where("least < most").select("w1", "w2", "least"), "dedup-first")
    repeats = windows.join(first, ["w1", "w2"]).where("key > least").groupBy("key").agg(F.collect_set("w1").alias("ws"))
    marked = docs.join(repeats.join(copied, "key", "full"), "key", "left").withColumn("copy", is_copy)
    return kept_rows(marked, *shape).withColumnRenamed("key", key)


def op2_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE least < doc_id),
kept AS (
  SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
