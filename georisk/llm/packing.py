"""Packing of tokenized documents into windows by minimum bin slack.

Every document is cut into whole windows and one shorter piece. Only the *number*
of remaining pieces of each length decides how windows are filled, so the plan is
made on that histogram (at most ``capacity`` rows, whatever the input): a window
starts with the longest remaining piece; a bitset subset-sum table over the
remaining lengths, longest first, tells which sums can be reached; the sum closest
to the capacity is traced back to a count per length, and that filling is used as
often as the histogram allows. A gap of ``least_cut`` tokens or more, which no
remaining piece fits, is filled by cutting one of them; its rest goes on as a piece
of its own. Pieces of one length are interchangeable: the n-th of them takes the
n-th place that the plan has for its length. Its number is that of its task (counted
where the piece was made) plus the counts of the tasks before, so no group is sorted
and a hot length only meets as many rows as one task made.

Defined cases: null text -> empty; an empty document still has its end id; texts
are cut at token borders only, each id in one piece; a document that fills windows
exactly has no shorter piece; repeated rows are documents of their own; a null key
is kept; empty input -> no pieces; other columns are not read. The strings of special
tokens in a text are ordinary text.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.bpe import production
from georisk.llm.common import slices, table, written

CAPACITY = 1024
END = 0
#: A gap of at least so many tokens is filled by cutting a piece.
LEAST_CUT = 16
#: Runs of white space from this length on go to the library whose splitter does not recurse.
LONG_BLANK = 1 << 16
#: Placed parts of cut pieces are broadcast, without ids, up to so many rows.
BROADCAST_ROWS = 100_000
#: Ranks of pieces of one length lie below this bound.
RANKS = 1 << 44


def public_encoder() -> Callable[[str], np.ndarray]:
    """Text -> ids as ``tokenizers`` gives them with byte_bpe_50k.json, without special tokens.

    The same vocabulary as ranks gives the same ids five times as fast; texts with very
    long runs of white space, on which that library overflows its stack, go to ``tokenizers``.
    """
    import tiktoken

    ranks, pattern = production()
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(r"\s{%d}" % LONG_BLANK)
    slow = []

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_BLANK or not blank.search(text):
            return fast.encode_to_numpy(text).astype(np.uint32, copy=False)
        if not slow:
            import public_tokenizers
            from tokenizers import Tokenizer
            slow.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            slow[0].encode_special_tokens = True
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def pieces(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end: int = END,
           encoder: Callable[[], Callable[[str], np.ndarray]] = public_encoder) -> DataFrame:
    """(key, start, length, doc_tokens, ids, ids_crc32, task, nth): the document's ids and its end
    id cut into windows; ``nth`` numbers the pieces of one length that one task made."""
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["key"], *T._parse_datatype_string(
        "start bigint, length int, doc_tokens bigint, ids array<int>, ids_crc32 bigint, task int, nth bigint").fields])
    names, name = schema.fieldNames(), f"{encoder.__module__}.{encoder.__qualname__}"

    def run(batches):
        held = sys.modules.setdefault("georisk_llm_packing", ModuleType("georisk_llm_packing")).__dict__
        if name not in held:  # once per worker process
            held[name] = encoder()
        encode, made, task = held[name], np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 1):
                rows, starts, lengths, totals, nths, sums, ids = [], [], [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = np.append(encode(t or ""), np.uint32(end))
                    ids.append(found)
                    for at in range(0, len(found), capacity):
                        n = min(capacity, len(found) - at)
                        rows.append(i)
                        starts.append(at)
                        lengths.append(n)
                        totals.append(len(found))
                        sums.append(checksum(found[at: at + n]))
                        nths.append(int(made[n]))
                        made[n] += 1
                ends = np.concatenate([[0], np.cumsum(lengths)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                    pa.array(totals, pa.int64()), lists, pa.array(sums, pa.int64()), pa.array(np.full(len(rows), task), pa.int32()),
                    pa.array(nths, pa.int64())],
                    names=names)

    return src.mapInArrow(run, schema)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``room`` from below.

    Bit s of the table is set if the lengths so far reach the sum s. Lengths come longest
    first, and the table ends with the length that reaches ``room`` itself.
    """
    within = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        stages.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & within
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


@dataclass
class Plan:
    """Places by length and rank: ranks ``first ..`` of ``length`` stand ``each`` in a window
    from ``sequence`` on, at ``offset``; where ``cut`` is not 0, only the piece's first ``cut``
    ids do, and its rest is rank ``next_first ..`` of the length that is left."""

    rows: list[tuple[int, int, int, int, int, int, int]]
    sequences: int

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("length", "first", "each", "sequence", "offset", "cut", "next_first")
        found = np.array(sorted(self.rows), np.int64).reshape(-1, len(names))
        return dict(zip(names, found.T)) | {"at": found[:, 0] * RANKS + found[:, 1]}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> Plan:
    """Fillings for a histogram of lengths (1 .. capacity), by minimum bin slack."""
    left = {n: c for n, c in histogram.items() if c}
    used: Counter = Counter()  # ranks given away, by length
    ranks = Counter(left)  # ranks there are, rests of cut pieces included
    rows, sequence = [], 0
    while left:
        seed = max(left)
        others = {n: c - (n == seed) for n, c in left.items() if c > (n == seed)}
        filling = Counter(closest(others, capacity - seed))
        filling[seed] += 1
        gap, cut = capacity - sum(n * c for n, c in filling.items()), 0
        if gap >= least_cut:  # no remaining piece fits, so any is longer than the gap
            cut = max((n for n, c in left.items() if c > filling[n]), default=0)
        need = filling + Counter([cut] if cut else [])
        times = min(left[n] // c for n, c in need.items())
        offset = 0
        for n, c in sorted(filling.items(), reverse=True):
            for i in range(c):  # the i-th of the c pieces of this length in a window
                rows.append((n, used[n], times, sequence, offset, 0, 0))
                used[n] += times
                offset += n
        if cut:
            rest = cut - gap
            rows.append((cut, used[cut], times, sequence, offset, gap, ranks[rest]))
            used[cut] += times
            ranks[rest] += times
            left[rest] = left.get(rest, 0) + times
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        sequence += times
    return Plan(rows, sequence)


def places(found: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray):
    """(row, from, length, sequence, offset) of the places of pieces given by length and rank."""
    row, done = np.arange(len(length)), np.zeros(len(length), np.int64)
    out = []
    while len(row):
        at = np.searchsorted(found["at"], length * RANKS + rank, "right") - 1
        cut, nth = found["cut"][at], rank - found["first"][at]
        out.append((row, done, np.where(cut > 0, cut, length), found["sequence"][at] + nth, found["offset"][at]))
        more = cut > 0
        row, done, length, rank = (x[more] for x in (row, done + cut, length - cut, found["next_first"][at] + nth))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 5)]


def placed(cut: DataFrame, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> DataFrame:
    """``cut`` (written rows of :func:`pieces`, any columns beside length, task and nth), one row
    per placed piece: adds ``skip`` (ids of the row before it), ``take``, ``sequence_id``, ``offset``."""
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    found = plan(histogram, capacity, least_cut).arrays()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = cut.join(bases, ["length", "task"]).withColumn("__rank", F.col("__base") + F.col("nth")).select(*cut.columns, "__rank")
    schema = T.StructType([*cut.schema.fields, *T._parse_datatype_string(
        "skip bigint, take bigint, sequence_id bigint, offset bigint").fields])
    at, n = cut.columns.index("length"), len(cut.columns)
    shipped = cut.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for b in batches:
            row, *cols = places(shipped.value, b.column(at).to_numpy().astype(np.int64), b.column(n).to_numpy())
            keep = b.take(pa.array(row, pa.int64())).columns[:n]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(c, pa.int64()) for c in cols]], names=schema.fieldNames())

    return ranked.mapInArrow(run, schema)


def pack(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end: int = END, least_cut: int = LEAST_CUT,
         encoder: Callable[[], Callable[[str], np.ndarray]] = public_encoder) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids) of every placed piece."""
    cut = written(pieces(df, key, text, capacity, end, encoder), "pack-pieces")
    return placed(cut, capacity, least_cut).select(
        F.col("key").alias(key), (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens",
        "sequence_id", "offset", F.slice("ids", F.col("skip").cast("int") + 1, F.col("take").cast("int")).alias("ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of every window: at most ``capacity`` ids each."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("ids"))


def _cut_checksums(parts: DataFrame, cut: DataFrame) -> DataFrame:
    """``parts`` (placed rows shorter than their piece in ``cut``) with the checksum of their own ids."""
    mine = ["length", "task", "nth"]
    keys = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    src = cut.select(*mine, "ids").join(keys, mine).select(*parts.columns, F.slice(
        "ids", F.col("skip").cast("int") + 1, F.col("take").cast("int")).alias("ids"))
    schema = T.StructType([*parts.schema.fields, T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for b in batches:
            sums = [checksum(x.values.to_numpy().view(np.uint32)) for x in b.column(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def op11_packing(spark, sf_dir):
    """The ids stay where they were written: only pieces that the plan cuts meet them again."""
    cut = written(pieces(table(spark, sf_dir, "documents"), "doc_id"), "pack-pieces")
    found = written(placed(cut.drop("ids")), "pack-placed")
    parts = _cut_checksums(found.where("take < length").drop("ids_crc32"), cut)
    return found.where("take = length").unionByName(parts).select(
        F.col("key").alias("doc_id"), (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"),
        "ids_crc32", "doc_tokens", "sequence_id", "offset")
