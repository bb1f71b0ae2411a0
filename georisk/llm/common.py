"""Helpers shared by the text operators: written tables that cut lineage, and
Arrow batches handled in slices of bounded size."""

from __future__ import annotations

import ctypes
import gc
import sys
from types import ModuleType
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.session import shared_path

#: Bytes of text that one call of a text function sees, unless one text alone is longer.
SLICE_BYTES = 1 << 20
#: Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Name under which a worker process keeps what serves later tasks.
REGISTRY = "georisk_llm_worker"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later reads survive
    lost executors and never repeat the work."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row (maps, which have no order, as their sorted entries)."""
    return F.xxhash64(*[F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
                        for f in df.schema])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    a = pc.fill_null(texts, "") if texts.null_count else texts
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset: a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns what this process has freed to the system, for the executor beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, T.DataType]],
              make: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES, owner: str = "") -> DataFrame:
    """One output row per row: ``keep`` columns as they are, then ``fields``.

    ``make`` runs once per task and returns a function from a slice of texts to
    one list or array per field. What it keeps in the worker's registry stays for
    later tasks of the same ``owner``; tasks of others let go of it.
    """
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, t) for n, t in fields]])
    names, n_keep = schema.fieldNames(), len(keep)
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(),
             T.IntegerType(): pa.int32(), T.ArrayType(T.LongType()): pa.list_(pa.int64()),
             T.ArrayType(T.StringType()): pa.list_(pa.string())}
    types = [kinds[t] for _, t in fields]

    def run(batches):
        held = sys.modules.setdefault(REGISTRY, ModuleType(REGISTRY)).__dict__
        if held.get("owner") != owner:
            for name in [n for n in held if not n.startswith("__")]:
                del held[name]
            gc.collect()
            give_back()
            held["owner"] = owner
        fn = make()
        for b in batches:
            for part in slices(b, n_keep, limit):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(fn(part.column(n_keep)), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *cols], names=names)
        give_back()

    return src.mapInArrow(run, schema)


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
    """Start and end byte of each word, and the index of its first word per text
    (``len(offsets)`` entries). Texts lie end to end, so a text's start also starts a word."""
    word = ~blank[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.have = base, _powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.have):
            self.have = _powers(self.base, max(n, 2 * len(self.have)))
        return self.have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words and of runs of consecutive words (Karp-Rabin modulo
    2**64 over mixed word hashes)."""

    def __init__(self, byte_base: int = 0x9E3779B97F4A7C15, word_base: int = 0xD6E8FEB86659FD93):
        self.bytes_, self.inverse = Powers(byte_base), Powers(pow(byte_base, -1, 1 << 64))
        self.words_, self.back = Powers(word_base), Powers(pow(word_base, -1, 1 << 64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.bytes_.upto(n), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse.upto(n)[starts])

    def windows(self, words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``words[i : i + length]`` for each i in ``at``; all must lie within."""
        if not len(at):
            return np.zeros(0, np.uint64)
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.words_.upto(n), out=sums[1:])
        return mixed((sums[at + length] - sums[at]) * self.back.upto(n)[at])
