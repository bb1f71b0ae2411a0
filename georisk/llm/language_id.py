"""Language identification by cross-parsing entropy.

Each language is represented by a suffix automaton of labelled text. A document
is cut greedily into the longest phrases that occur in that text; the language
that needs the fewest phrases, normalised by log2 of its text's length and by
the document's length, wins (the cross-parsing estimate of cross-entropy).

The automata are fitted on a bounded sample: the whole texts of at most
``docs_per_language`` labelled documents per language, one from each of as many hash
buckets: the smallest key hash among texts of at most ``MODEST`` characters, or
among the longer ones where a bucket has no other. Every letter of the samples has a
class of its own. Transitions are full tables while those of all languages
together stay below ``DENSE_BYTES``, else sorted keys.

Texts are cut into blocks of ``BLOCK`` characters so that the blocks of many documents
advance together. A block starts in the state in which the one before it ended: it
is parsed from the automaton's start first, and again wherever that state turns
out to be another, until all agree. So the parse is that of the whole text.

Defined cases: text null or without a letter -> ``und`` with score 0; no
labelled text at all -> ``und``; ties -> the smaller language name, score 0;
one row out per row in, repeated rows included; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from georisk.llm.common import map_texts

BLOCK = 256
#: Texts of up to so many characters are preferred in the sample.
MODEST = 4000
#: Full transition tables (states x classes x 4 bytes) of all languages take at most so much of a worker.
DENSE_BYTES = 160 << 20
GAP, OTHER = 0, 255


def labelled_sample(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    docs_per_language: int = 24) -> dict[str, list[str]]:
    """Per language, the whole texts of at most ``docs_per_language`` documents."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"))
    bucket = F.pmod(F.xxhash64("h"), F.lit(docs_per_language))
    best = F.min(F.struct((F.length("text") > MODEST).alias("long"), "h"))
    picks = rows.groupBy("lang", bucket.alias("b")).agg(best.alias("p")).select("lang", F.col("p.h").alias("h"), F.col("p.long").alias("long"))
    # One row per language and bucket; the texts of those rows only.
    chosen = rows.join(F.broadcast(picks), ["lang", "h"]).where((F.length("text") > MODEST) == F.col("long"))
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.groupBy("lang", "h").agg(F.min("text").alias("t")).collect()):
        out.setdefault(r.lang, []).append(r.t)
    return out


def letters_of(text: str) -> str:
    """Lower-cased letters, every run of other characters as one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    return go


class SparseTable:
    """Reads like the full transition table, but keeps only the automaton's edges.
    ``restart`` is the full table's first row: the moves of a new phrase."""

    dtype = np.dtype(np.int64)

    def __init__(self, edges: np.ndarray, width: int):
        first, inner = edges[edges[:, 0] == 0], edges[edges[:, 0] > 0].astype(np.int64)
        self.width = width
        self.restart = np.ones(width, np.int64)
        self.restart[first[:, 1]] += first[:, 2].astype(np.int64) * width * 2
        keys, moves = inner[:, 0] * width + inner[:, 1], inner[:, 2] * width * 2
        order = np.argsort(keys)
        self.keys, self.moves = np.append(keys[order], -1), np.append(moves[order], 0)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        chars = at % self.width
        i = np.searchsorted(self.keys[:-1], at)
        found = np.where(self.keys[i] == at, self.moves[i], self.restart[chars])
        return np.where(chars == self.width - 1, 2 * (at - chars), found)


class LanguageModel:
    """Automata of all languages as sparse transitions; small enough to ship."""

    def __init__(self, sample: dict[str, list[str]] | None = None, shipped: tuple | None = None):
        if shipped is not None:
            self.languages, self.alphabet, self.log_size, self.edges = shipped
            return
        texts = {k: letters_of("\n".join(v)) for k, v in sorted((sample or {}).items())}
        texts = {k: t for k, t in texts.items() if t}
        self.languages = list(texts)
        counts: dict[str, int] = {}
        for t in texts.values():
            for c in t.replace(" ", ""):
                counts[c] = counts.get(c, 0) + 1
        self.alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        ids = {c: i + 1 for i, c in enumerate(self.alphabet)} | {" ": GAP}
        self.log_size = [math.log2(len(t) + 1) for t in texts.values()]
        self.edges = []
        for t in texts.values():
            go = suffix_automaton(t)
            e = [(s, ids[c], to) for s, out in enumerate(go) for c, to in out.items()]
            self.edges.append((len(go), np.array(e, np.int32)))

    def plain(self) -> tuple:
        return self.languages, self.alphabet, self.log_size, self.edges

    def tables(self) -> tuple[np.ndarray, list[np.ndarray | SparseTable], int]:
        """Character classes, one transition table per language, its width.

        Entry ``state * width + class`` holds ``2 * next_row + starts_phrase``,
        where next_row is already a multiple of the width. Two extra classes: a
        letter never seen (a phrase of its own) and padding (no move).
        """
        width = len(self.alphabet) + 3
        classes = np.zeros(0x110000, np.min_scalar_type(width - 1))
        classes[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = width - 2
        for i, c in enumerate(self.alphabet):
            classes[ord(c)] = i + 1
        if sum(states for states, _ in self.edges) * width * 4 > DENSE_BYTES:
            return classes, [SparseTable(e, width) for _, e in self.edges], width
        out = []
        for states, e in self.edges:
            t = np.full((states, width), -1, np.int64)
            t[e[:, 0], e[:, 1]] = e[:, 2].astype(np.int64) * width * 2
            restart = np.where(t[0] >= 0, t[0], 0) + 1
            t = np.where(t >= 0, t, restart)
            t[0, t[0] % 2 == 0] += 1  # leaving the start begins a phrase
            t[:, width - 1] = np.arange(states) * width * 2
            out.append(t.ravel().astype(np.int32) if states * width < 1 << 29 else t.ravel())
        return classes, out, width


def _blocks(texts: list[str], classes: np.ndarray, pad: int):
    """Classes of all texts in rows of ``BLOCK``, the first row of each text, letters of each."""
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cls = classes[codes]
    stop = codes == 0
    keep = cls != GAP
    letters = np.concatenate([[0], np.cumsum(keep)])
    keep[1:] |= (cls[1:] == GAP) & (cls[:-1] != GAP) & ~stop[1:]
    cuts = np.concatenate([[0], np.flatnonzero(stop), [len(codes)]])
    kept = np.concatenate([[0], np.cumsum(keep)])
    sizes, n_letters = np.diff(kept[cuts]), np.diff(letters[cuts])
    rows = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(rows)])
    grid = np.full(int(first[-1]) * BLOCK, pad, classes.dtype)
    shift = np.repeat(first[:-1] * BLOCK - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    grid[np.arange(len(shift)) + shift] = cls[keep]
    return np.ascontiguousarray(grid.reshape(-1, BLOCK).T), first, sizes, n_letters


def _run(columns: np.ndarray, table: np.ndarray | SparseTable, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases begun in each block when it starts in ``row``, and the row it ends in."""
    count = np.zeros(columns.shape[1], np.int32)
    for chars in columns:
        move = table[row + chars]
        count += move & 1
        row = move >> 1
    return count, row


def phrases(columns: np.ndarray, table: np.ndarray | SparseTable, first: np.ndarray) -> np.ndarray:
    """Phrases of each text: its blocks are the columns from ``first[i]`` to ``first[i + 1]``."""
    start = np.zeros(columns.shape[1], table.dtype)
    count, end = _run(columns, table, start)
    heads = first[:-1][first[:-1] < first[1:]]
    while True:
        before = np.concatenate([start[:1], end[:-1]])
        before[heads] = 0
        again = np.flatnonzero(before != start)
        if not len(again):
            break
        start[again] = before[again]
        count[again], end[again] = _run(columns[:, again], table, start[again])
    total = np.concatenate([[0], np.cumsum(count)])
    return np.diff(total[first])


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None,
             pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` columns (all by default) plus the predicted language and its score:
    how far below the runner-up's the winner's normalised phrase count lies, 0 to 1."""
    shipped = df.sparkSession.sparkContext.broadcast(model.plain())

    def make():  # once per task: an idle worker holds no tables beside the next operator's needs
        m = LanguageModel(shipped=shipped.value)
        classes, tables, width = m.tables() if m.languages else (None, [], 0)

        def fn(col: pa.Array):
            n = len(col)
            if not tables:
                return [["und"] * n, [0.0] * n]
            columns, first, sizes, letters = _blocks([t or "" for t in col.to_pylist()], classes, width - 1)
            cost = np.zeros((len(tables), n))
            for i, t in enumerate(tables):
                cost[i] = phrases(columns, t, first) * m.log_size[i] / np.maximum(sizes, 1)
            best = np.argmin(cost, axis=0)
            low = cost[best, np.arange(n)]
            if len(tables) > 1:
                second = np.partition(cost, 1, axis=0)[1]
                gain = np.where(second > 0, 1 - low / np.maximum(second, 1e-300), 0.0)
            else:
                gain = np.ones(n)
            known = letters > 0
            return [[m.languages[b] if k else "und" for b, k in zip(best, known)],
                    np.where(known, np.clip(gain, 0, 1), 0.0)]

        return fn

    return map_texts(df, text, df.columns if keep is None else keep,
                     [(pred, T.StringType()), (score, T.DoubleType())], make)


def held_out(key: Column) -> Column:
    """The fold that is never learnt from; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame) -> LanguageModel:
    known = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return LanguageModel(labelled_sample(known))


def op1_language_id(spark, sf_dir):
    from georisk.llm.common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(marked, fit(docs), keep=["doc_id", "held_out"])
