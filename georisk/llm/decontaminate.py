"""Benchmark decontamination by greedy string tiling.

Words are compared by 64-bit hashes, lower-cased and without punctuation. Seeds
(``SEED`` consecutive words) of benchmark items are looked for in documents; only
document words inside shared seeds go on, cut into runs. For each (document, item)
pair, tiling repeatedly marks the longest matches that overlap no earlier tile,
found by running Karp-Rabin hashes of a shrinking search length, down to ``SEED``
words. The share of an item's words that lie in tiles is its coverage, so reordered
passages count in full; a document that covers at least ``threshold`` of an item is
contaminated by it.

Pairs come from an exact prefix filter: tiles consist of shared seeds, so a document
whose shared seeds all belong to a set that covers less than ``threshold`` of the
item can't reach it. Per item the seeds found in most documents form that set, as
large as it may get; only the rarer ones are joined. A phrase in every document and
every item thus gives no pairs, unless it covers enough of an item to count by itself.

Before the join a Bloom filter of the benchmark's seeds passes over the documents. It
has at most ``BLOOM_BITS`` bits; a larger benchmark lets more words through to the
join, which decides, and changes no result.

Defined cases: null, empty or wordless texts and items match nothing; null keys
of documents or items are ignored, as they can't be named in the result; an item
shorter than a seed is one seed as a whole; rows that repeat a document's key are its
parts, whose tiles add up (words tiled in several parts count once, ``n_tiles`` is the
sum); rows that repeat an item's key are its versions, of which the one covered best
counts; ties between equally long matches go to the earlier place in the item, then in
the document; empty input -> empty output; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.common import WordHash, flat, mixed, slices, table, word_bounds, written

SEED = 5
THRESHOLD = 0.5
#: The Bloom filter has at least 32 bits a seed, up to this many (8 MB).
BLOOM_BITS = 1 << 26
BLOOM_HASHES = 4
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32768
#: ASCII characters other than letters and digits part words; all others belong to them.
PARTING = np.zeros(256, bool)
PARTING[[i for i in range(128) if not chr(i).isalnum()]] = True
WORD_BASE = 0x9E3779B97F4A7C55


def _words(texts: pa.Array, hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each text."""
    lower = pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.large_string())
    data, offsets = flat(lower)
    starts, ends, first = word_bounds(data, offsets, PARTING)
    return hasher.words(data, starts, ends), first


def _seeds(words: np.ndarray, first: np.ndarray, hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole seeds, which do not cross texts, and their hashes."""
    sizes = np.diff(first)
    left = np.repeat(first[1:], sizes) - np.arange(first[0], first[0] + len(words))
    at = np.flatnonzero(left >= SEED)
    return at, hasher.windows(words, at, SEED)


def _short(words: np.ndarray) -> np.uint64:
    """Seed hash of a whole item of fewer words than a seed."""
    h = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = mixed((h ^ w) * np.uint64(0x9E3779B97F4A7C15))
    return h


def item_words(items: DataFrame) -> DataFrame:
    """(item, words, seeds) of the benchmark's (item, text), a seed for each of its places."""
    def run(batches):
        hasher = WordHash()
        for b in batches:
            for part in slices(b, 1):
                words, first = _words(part.column(1), hasher)
                at, h = _seeds(words, first, hasher)
                cut = np.searchsorted(at, first)
                rows = [words[x:y].view(np.int64) for x, y in zip(first[:-1], first[1:])]
                seeds = [h[x:y].view(np.int64) if y > x else
                         np.array([_short(words[p:q])], np.uint64).view(np.int64) if q > p else np.zeros(0, np.int64)
                         for x, y, p, q in zip(cut[:-1], cut[1:], first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64())),
                                                  pa.array(seeds, pa.list_(pa.int64()))], names=["item", "words", "seeds"])

    schema = T.StructType([items.schema["item"], T.StructField("words", T.ArrayType(T.LongType())),
                           T.StructField("seeds", T.ArrayType(T.LongType()))])
    return items.select("item", "text").mapInArrow(run, schema)


def bloom(seeds: DataFrame, n: int) -> np.ndarray:
    """Bits of a Bloom filter of the ``n`` values in column seed, as bytes; at most ``BLOOM_BITS``."""
    bits = BITMAP
    while bits < min(32 * n, BLOOM_BITS):
        bits *= 2
    first = F.col("seed").bitwiseAND(bits - 1)
    step = F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1).bitwiseOR(F.lit(1))
    # Bits are numbered from 1 here, so that bitmap i has those from i * BITMAP on.
    at = seeds.select(F.explode(F.array(*[(first + step * i).bitwiseAND(bits - 1) + 1 for i in range(BLOOM_HASHES)])).alias("at"))
    maps = at.groupBy((F.bitmap_bucket_number("at") - 1).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():
        out[r.i * (BITMAP // 8): (r.i + 1) * (BITMAP // 8)] = np.frombuffer(r.b, np.uint8)
    return out


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    mask = np.uint64(8 * len(bits) - 1)
    first, step = h & mask, (h >> np.uint64(32)) & mask | np.uint64(1)
    hit = np.ones(len(h), bool)
    for i in range(BLOOM_HASHES):
        at = (first + step * np.uint64(i)) & mask
        hit &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


def document_seeds(docs: DataFrame, known: np.ndarray, lengths: list[int]) -> DataFrame:
    """(key, seeds, runs): seeds that the filter ``known`` lets through, and the
    document's words around them in runs parted by 0; ``lengths`` are the sizes of
    items shorter than a seed."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        hasher = WordHash()
        for b in batches:
            for part in slices(b, 1):
                words, first = _words(part.column(1), hasher)
                at, h = _seeds(words, first, hasher)
                size = np.full(len(at), SEED)
                for n in lengths:  # whole short items may stand anywhere in a text
                    more = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(words)) >= n)
                    short = np.full(len(more), n, np.uint64)
                    with np.errstate(over="ignore"):
                        for i in range(n):
                            short = mixed((short ^ words[more + i]) * np.uint64(0x9E3779B97F4A7C15))
                    at, h, size = np.concatenate([at, more]), np.concatenate([h, short]), np.concatenate([size, np.full(len(more), n)])
                hit = in_bloom(sent.value, h)
                at, h, size = at[hit], h[hit], size[hit]
                order = np.argsort(at, kind="stable")
                at, h, size = at[order], h[order], size[order]
                inside = np.zeros(len(words) + 1, np.int64)
                np.add.at(inside, at, 1)
                np.add.at(inside, at + size, -1)
                inside = np.cumsum(inside)[:-1] > 0
                cut = np.searchsorted(at, first)
                rows, seeds, runs = [], [], []
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(first[i], first[i + 1])
                    # One 0 after each run: words outside runs shrink to it.
                    kept = np.where(inside[s], words[s], np.uint64(0))
                    some = (kept != 0) | np.concatenate([[False], kept[:-1] != 0])
                    rows.append(i)
                    seeds.append(np.unique(h[cut[i]: cut[i + 1]]).view(np.int64))
                    runs.append(kept[some].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(seeds, pa.list_(pa.int64())),
                     pa.array(runs, pa.list_(pa.int64()))], names=["key", "seeds", "runs"])

    schema = T.StructType([docs.schema["key"], T.StructField("seeds", T.ArrayType(T.LongType())),
                           T.StructField("runs", T.ArrayType(T.LongType()))])
    return docs.select("key", "text").mapInArrow(run, schema)


def _free_starts(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of ``n`` consecutive free places."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[n:] == taken[:-n])


def tiles(item: np.ndarray, doc: np.ndarray, least: int, hasher: WordHash) -> list[tuple[int, int, int]]:
    """Greedy string tiles (item start, document start, length), longest first. The
    document's 0 entries match nothing."""
    free_item, free_doc, out = np.ones(len(item), bool), doc != 0, []
    length = min(len(item), len(doc))
    while length >= least:
        at_item, at_doc = _free_starts(free_item, length), _free_starts(free_doc, length)
        h_item, h_doc = hasher.windows(item, at_item, length), hasher.windows(doc, at_doc, length)
        both = np.intersect1d(h_item, h_doc)
        if not len(both):
            if length == least:
                break
            # Equal windows of this length are missing; halve the span that is still possible.
            low, high = least, length - 1
            while low < high:
                mid = (low + high + 1) // 2
                if len(np.intersect1d(hasher.windows(item, _free_starts(free_item, mid), mid),
                                      hasher.windows(doc, _free_starts(free_doc, mid), mid))):
                    low = mid
                else:
                    high = mid - 1
            length = low
            at_item, at_doc = _free_starts(free_item, length), _free_starts(free_doc, length)
            h_item, h_doc = hasher.windows(item, at_item, length), hasher.windows(doc, at_doc, length)
            both = np.intersect1d(h_item, h_doc)
            if not len(both):
                break
        places: dict[int, list[int]] = {}
        for p, h in zip(at_doc[np.isin(h_doc, both)].tolist(), h_doc[np.isin(h_doc, both)].tolist()):
            places.setdefault(h, []).append(p)
        for p, h in zip(at_item.tolist(), h_item.tolist()):
            if h in places and free_item[p: p + length].all():
                for q in places[h]:
                    if free_doc[q: q + length].all() and (item[p: p + length] == doc[q: q + length]).all():
                        free_item[p: p + length] = free_doc[q: q + length] = False
                        out.append((p, q, length))
                        break
        length -= 1
    return out


def rare_seeds(bench: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """(version, seed): the seeds of which a document must have one to cover ``threshold``
    of an item's version. The others are the ones in most documents; all the words that
    they cover are too few."""
    spread = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    places = bench.select("version", F.size("words").alias("size"), F.posexplode("seeds").alias("at", "seed")).join(spread, "seed")
    by = places.groupBy("version", "size").agg(F.collect_list(F.struct("n", "seed", "at")).alias("places"))

    def run(batches):
        for b in batches:
            out = []
            for size, row in zip(b.column(1).to_pylist(), b.column(2)):
                n, seed, at = (row.values.field(i).to_numpy() for i in range(3))
                seeds, one, where = np.unique(seed, return_index=True, return_inverse=True)
                rank = np.empty(len(seeds), np.int64)
                rank[np.lexsort((seeds, -n[one]))] = np.arange(len(seeds))
                # A word is covered from the rank of the commonest seed over it on.
                cover = np.full(size, len(seeds), np.int64)
                for i in range(min(SEED, size)):
                    np.minimum.at(cover, at + i, rank[where])
                cover = np.sort(cover)
                enough = np.flatnonzero(np.arange(1, size + 1) / size >= threshold)
                out.append(seeds[rank >= cover[enough[0]]] if len(enough) else seeds[:0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["version", "seeds"])

    schema = T.StructType([T.StructField("version", T.LongType()), T.StructField("seeds", T.ArrayType(T.LongType()))])
    return by.mapInArrow(run, schema).select("version", F.explode("seeds").alias("seed"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_key, n_tiles, covered, coverage) of each contaminated pair."""
    src = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    bench = written(item_words(items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text"))).where("size(words) > 0").withColumn(
            "version", F.monotonically_increasing_id()), "bench-items")
    size, n_seeds = bench.agg(F.collect_set(F.when(F.size("words") < SEED, F.size("words"))), F.sum(F.size("seeds"))).first()
    known = bloom(bench.select(F.explode("seeds").alias("seed")), n_seeds or 0)
    hits = written(document_seeds(src, known, sorted(size)), "bench-hits")
    pairs = hits.select("key", F.explode("seeds").alias("seed")).join(
        rare_seeds(bench, hits, threshold), "seed").select("key", "version").distinct()
    joined = pairs.join(bench.select("version", "item", "words"), "version").join(hits.select("key", "runs"), "key").select(
        "key", "item", "version", "words", "runs")

    def run(batches):
        hasher = WordHash(word_base=WORD_BASE)
        for b in batches:
            rows, sizes, n, blocks, maps = [], [], [], [], []
            for r, (words, doc) in enumerate(zip(b.column(3), b.column(4))):
                item = words.values.to_numpy().view(np.uint64)
                found = tiles(item, doc.values.to_numpy().view(np.uint64), min(SEED, len(item)), hasher)
                inside = np.zeros(len(item), bool)
                for at, _, length in found:
                    inside[at: at + length] = True
                for i in range(0, len(item) if found else 0, BITMAP):
                    rows.append(r)
                    sizes.append(len(item))
                    n.append(0 if i else len(found))
                    blocks.append(i // BITMAP)
                    maps.append(np.packbits(inside[i: i + BITMAP], bitorder="little").tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(at) for i in range(3)], pa.array(sizes, pa.int64()), pa.array(blocks, pa.int32()),
                 pa.array(n, pa.int64()), pa.array(maps, pa.binary())],
                names=["key", "item", "version", "size", "block", "n_tiles", "inside"])

    schema = T.StructType([*joined.schema.fields[:3], T.StructField("size", T.LongType()), T.StructField("block", T.IntegerType()),
                           T.StructField("n_tiles", T.LongType()), T.StructField("inside", T.BinaryType())])
    version = ["key", "item", "version", "size"]
    parts = joined.mapInArrow(run, schema).groupBy(*version, "block").agg(
        F.sum("n_tiles").alias("n_tiles"), F.bitmap_count(F.bitmap_or_agg("inside")).alias("covered"))
    found = parts.groupBy(*version).agg(F.sum("n_tiles").alias("n_tiles"), F.sum("covered").alias("covered")).withColumn(
        "coverage", F.col("covered") / F.col("size")).where(F.col("coverage") >= threshold)
    best = found.groupBy("key", "item").agg(F.max(F.struct("coverage", "covered", "n_tiles")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item_key), "m.n_tiles", "m.covered", "m.coverage")


def op6_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
