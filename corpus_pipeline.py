"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. :func:`run` writes each stage's result and
reads it back for the next one. Columns added on the way begin with ``__`` and are
dropped again, so extra columns of the input pass through unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.llm import bpe, decontaminate, language_id, pii, simhash
from georisk.llm.common import content_hash, table, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language (null text, or no letter in it)."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model, keep=docs.columns, pred="__pred", score="__score")
    return found.where(F.col("__pred") != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group (3-word shingles, at most 3 differing bits)."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item; rows are told apart by id and content."""
    marked = docs.withColumn("__row", F.concat_ws(":", "doc_id", content_hash(docs)))
    found = decontaminate.contaminated(marked.select("__row", "text"), table(spark, sf_dir, "benchmark"), key="__row")
    return marked.join(found.select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars`` follows the text."""
    found = pii.detect(docs.withColumn("__text", F.col("text")), docs.columns, "__text")
    changed = F.size("__spans") > 0
    clean = found.withColumn("__clean", pii.redacted(F.col("text"), F.col("__spans")))
    new = {"text": F.when(changed, F.col("__clean")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumns(new).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the round trip."""
    ranks, pattern = bpe.production()
    return bpe.digests(docs, ranks, pattern, keep_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_and_decode),
]

#: SQL can't express SimHash, string tiling or the merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
