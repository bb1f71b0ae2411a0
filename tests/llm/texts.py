"""Small documents with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "fp bigint, component bigint, __hint string, ids array<bigint>, seed string, shard int")
EXTRA = (7, 8, "x", [1, 2], "s", 3)


def documents(spark, rows, partitions=3):
    """Rows of (doc_id, text, lang), with extra columns that clash with names used inside."""
    full = [(i, t, lang, "src", None if t is None else len(t), *EXTRA) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(seed, n, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(n))


def awkward():
    long_run = "a" * 60_000
    return [(None, "no id at all", "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", None),
            (4, "é ü 😀   x", "fr"), (5, "same row", "en"), (5, "same row", "en"), (5, "same id, other text", None),
            (6, long_run, "en"), (7, ("word " * 20_000).strip(), "de"), (8, "\0 null byte \0", "en")]
