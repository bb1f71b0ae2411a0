"""Ranked lexical search over inverted shards, part term at a time, part document at a time.

Documents become rows of (query term, occurrences); a task turns its rows into
inverted shards of bounded size: per term the documents in order, each with its
impact, and the largest impact of each run of ``RUN`` documents. For every item
the short lists of a shard are summed term at a time into accumulators. These,
sorted, are one more list with a known maximum, and the item goes on document
at a time over that list and the long ones. The lists whose maxima together
stay below the item's k-th best score so far open no document; runs whose maxima
stay below it are skipped; a document that the other lists found is looked up in
them only while it can still reach that score. Items keep their k-th best score
from shard to shard of a task; the lists of best documents are merged as a tree.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, which bounds the
vocabulary a worker holds; every block meets every document.

Defined cases: null text -> no terms, as for a text without any; such documents
count nowhere and such items get no rows; a repeated document is ranked as often as
it occurs, a repeated item gets its list as often; equal scores go by ascending key,
null keys last; empty tables -> no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.common import slices, table, written

BLOCK_TERMS = 200_000
#: Postings of one shard, unless a single document has more.
SHARD_POSTINGS = 2_000_000
#: Documents of a run that share one maximum, and runs that are scored together.
RUN = 128
STEP = 64
#: Short lists of an item hold so many postings together, at most.
ACCUMULATORS = 4096
FAN_IN = 16
PART = 1 << 22
#: Bytes of terms: digits, letters (in lower case) and all beyond ASCII; the rest parts them.
FOLDED = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        to = at + PART
        part = text[at:to].translate(FOLDED)
        while to < len(text) and FOLDED[text[to]] != 0x20:  # up to the end of the last term
            more = text[to: to + 4096].translate(FOLDED)
            end = more.find(b" ")
            part += more if end < 0 else more[:end]
            to += len(more) if end < 0 else end
        yield part.split()
        at = to


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, terms) of every item with a term: its distinct terms."""
    src = items.select(F.col(f"`{key}`").alias("item"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))])

    def run(batches):
        for b in batches:
            found = [sorted({w for part in terms((t or "").encode()) for w in part}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    return src.mapInArrow(run, schema).where(F.size("terms") > 0)


def occurrences(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, ids, tfs) of every document with a term: its number of terms, and the
    vocabulary's terms in it with their occurrences."""
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["key"], *T._parse_datatype_string("n bigint, ids array<int>, tfs array<bigint>").fields])
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shipped.value.get
        for batch in batches:
            for b in slices(batch, 1):
                rows, ns, ids, tfs, ends = [], [], [], [], [0]
                for i, t in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                    n, found = 0, Counter()
                    for part in terms(t or b""):
                        n += len(part)
                        found.update(map(number, part))
                    if n:
                        found.pop(None, None)
                        rows.append(i)
                        ns.append(n)
                        ids.extend(found.keys())
                        tfs.extend(found.values())
                        ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, k)) for v, k in ((ids, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), *lists],
                                                 names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def lengths(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """The length norm m of documents with ``n`` terms."""
    if len(n) and int(n.max()) * count * 50 >= 1 << 62:
        return np.array([50 + 50 * int(x) * count // total for x in n], np.int64)
    return 50 + 50 * n * count // total


class Shard:
    """Inverted lists of some documents, which are numbered in order of their keys."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, weights: np.ndarray, count: int, total: int):
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        norm = lengths(n, count, total)[doc]
        impact = weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 20 * norm))
        order = np.argsort(ids, kind="stable")
        order = order[impact[order] > 0]
        self.size, self.doc, self.impact, ids = len(n), doc[order], impact[order], ids[order]
        self.bounds = np.searchsorted(ids, np.arange(len(weights) + 1))
        # One entry per (term, run of documents): where it starts and its largest impact.
        runs = self.doc // RUN
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (runs[1:] != runs[:-1])
        self.entry = np.flatnonzero(new)
        self.run, self.most = runs[self.entry], np.maximum.reduceat(self.impact, self.entry) if len(ids) else self.impact
        self.entries = np.searchsorted(ids[self.entry], np.arange(len(weights) + 1))
        self.entry = np.append(self.entry, len(ids))
        self.top = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.impact, self.bounds[held])
        self.scores = np.zeros(self.size, np.int64)

    def _list(self, term: int) -> slice:
        return slice(self.bounds[term], self.bounds[term + 1])

    def _runs(self, term: int, first: int, last: int) -> slice:
        """The postings of a term in the runs ``first`` .. ``last - 1``."""
        at = self.entries[term] + np.searchsorted(self.run[self.entries[term]: self.entries[term + 1]], (first, last))
        return slice(self.entry[at[0]], self.entry[at[1]]) if at[1] > at[0] else slice(0, 0)

    def _accumulated(self, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the documents of the short lists and their sums."""
        if not short:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in short:
            self.scores[self.doc[self._list(t)]] += self.impact[self._list(t)]
        docs = np.unique(np.concatenate([self.doc[self._list(t)] for t in short]))
        sums = self.scores[docs]
        self.scores[docs] = 0
        return docs, sums

    def best(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best of an item with a score of ``least`` or more."""
        sizes = self.bounds[item + 1] - self.bounds[item]
        item, sizes = item[sizes > 0], sizes[sizes > 0]
        order = np.argsort(sizes, kind="stable")
        n_short = int(np.searchsorted(np.cumsum(sizes[order]), ACCUMULATORS, "right"))
        docs, sums = self._accumulated(item[order[:n_short]].tolist())
        if len(docs) >= k:
            least = max(least, int(np.partition(sums, len(sums) - k)[-k]))
        long = sorted(item[order[n_short:]].tolist(), key=lambda t: int(self.top[t]))
        # Lists by rising maximum; number -1 stands for the accumulators.
        lists = sorted([*long, *[-1] * bool(len(docs))], key=lambda t: int(self.top[t]) if t >= 0 else int(sums.max()))
        tops = np.cumsum([int(self.top[t]) if t >= 0 else int(sums.max()) for t in lists])
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(lists) or tops[-1] < least:
            return found, scores
        n_runs = -(-self.size // RUN)
        most = np.zeros((len(lists), n_runs), np.int64)  # largest score that each list gives in each run
        for i, t in enumerate(lists):
            if t >= 0:
                e = slice(self.entries[t], self.entries[t + 1])
                most[i, self.run[e]] = self.most[e]
            else:
                np.maximum.at(most[i], docs // RUN, sums)
        reach = np.cumsum(most, axis=0)  # row i: lists 0 .. i together
        for first in range(0, n_runs, STEP):
            last = min(first + STEP, n_runs)
            alive = reach[-1, first:last] >= max(least, 1)
            if not alive.any():
                continue
            essential = int(np.searchsorted(tops, max(least, 1)))  # lists before it open no document
            lo, hi = first * RUN, min(last * RUN, self.size)
            part = self.scores[lo:hi]
            for t in lists[essential:]:
                if t >= 0:
                    s = self._runs(t, first, last)
                    self.scores[self.doc[s]] += self.impact[s]
                else:
                    a, b = np.searchsorted(docs, (lo, hi))
                    self.scores[docs[a:b]] += sums[a:b]
            open_ = np.flatnonzero(part)
            open_ = open_[alive[open_ // RUN]] + lo
            got = self.scores[open_]
            part[:] = 0
            for i in range(essential - 1, -1, -1):
                able = got + reach[i, open_ // RUN] >= least
                open_, got = open_[able], got[able]
                if not len(open_):
                    break
                if lists[i] >= 0:
                    s = self._list(lists[i])
                    where, values = self.doc[s], self.impact[s]
                else:
                    where, values = docs, sums
                at = np.searchsorted(where, open_)
                hit = at < len(where)
                hit[hit] = where[at[hit]] == open_[hit]
                got[hit] += values[at[hit]]
            good = got >= max(least, 1)
            found, scores = np.append(found, open_[good]), np.append(scores, got[good])
            if len(found) >= k:
                order = np.lexsort((found, -scores))[:k]
                found, scores = found[order], scores[order]
                least = max(least, int(scores[-1]))
        order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("q", *by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): the k best documents of every item."""
    asked = written(item_terms(items, item_key, item_text), "lexical-items")
    texts = written(asked.select("terms").distinct().withColumn("q", F.monotonically_increasing_id()), "lexical-queries")
    size = texts.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "terms").collect()
        best = _block(docs, mine, k, key, text)
        out = best if out is None else out.unionByName(best)
    named = asked.join(texts, "terms").select(F.col("item").alias("__item"), "q")
    return out.join(named, "q").select(F.col("__item").alias(item_key), F.col("rank").cast("int").alias("rank"),
                                       F.col("key").alias(key), "score")


def _block(docs: DataFrame, queries: list, k: int, key: str, text: str) -> DataFrame:
    """(q, rank, key, score) for one block of (q, terms)."""
    words = sorted({bytes(w) for r in queries for w in r.terms})
    number = {w: i for i, w in enumerate(words)}
    index = written(occurrences(docs, key, text, number), "lexical-index")
    totals = index.agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total")).first()
    frequency = np.zeros(len(words), np.int64)
    for r in index.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():
        frequency[r.id] = r.df  # one row per term of the block
    count, total = totals["count"], totals["total"] or 1
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in frequency], np.int64)
    asked = [(r.q, np.array(sorted(number[bytes(w)] for w in r.terms), np.int64)) for r in queries]
    shipped = docs.sparkSession.sparkContext.broadcast((asked, weights))
    schema = T.StructType([*T._parse_datatype_string("q bigint, task int, score bigint").fields, index.schema["key"]])

    def shard_of(parts):
        rows = pa.Table.from_batches(parts)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_end")).combine_chunks()
        ids, tfs = (rows[c].chunk(0) if rows[c].num_chunks else pa.array([], pa.list_(pa.int64())) for c in ("ids", "tfs"))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return rows["key"].combine_chunks(), Shard(rows["n"].to_numpy(), starts, ids.flatten().to_numpy().astype(np.int64),
                                                   tfs.flatten().to_numpy(), shipped.value[1], count, total)

    def run(batches):
        task, (queries, weights) = TaskContext.get().partitionId(), shipped.value
        tops = {}

        def settled(parts):
            keys, shard = shard_of(parts)
            for q, item in queries:
                item = item[weights[item] > 0]
                have = tops.get(q, np.zeros(0, np.int64))
                least = int(have.min()) if len(have) == k else 1
                found, scores = shard.best(item, k, least)
                if not len(found):
                    continue
                tops[q] = np.sort(np.append(have, scores))[-k:]
                yield q, keys.take(pa.array(found)), scores

        def rows(parts):
            got = list(settled(parts))
            if got:
                ns = [len(s) for _, _, s in got]
                one = pa.concat_arrays([x for _, x, _ in got])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([q for q, _, _ in got], ns), pa.int64()), pa.array(np.full(sum(ns), task), pa.int32()),
                    pa.array(np.concatenate([s for _, _, s in got]), pa.int64()), one], names=["q", "task", "score", "key"])

        held, size = [], 0
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SHARD_POSTINGS - size, "right")) - 1)
                held.append(batch.slice(at, to - at))
                size, at = size + int(ends[to] - ends[at]), to
                if size >= SHARD_POSTINGS or at < batch.num_rows:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    found = written(index.mapInArrow(run, schema), "lexical-found")
    tasks = (found.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        found = _ranked(found.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")), k, "task").drop("rank")
    return _ranked(found, k).select("q", "rank", "key", "score")


def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms_sql('text')} AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_terms_sql('text')}) AS t FROM benchmark),
asked AS MATERIALIZED (SELECT q, item_id, unnest(t) AS term FROM i),
total AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
held AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(total.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY term),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * held.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term), total GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""
