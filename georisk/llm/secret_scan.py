"""Secret scanning over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The
ledger has one row per (blob, rule, rule version) already scanned, with the
spans found. A scan takes the distinct blobs of its input, leaves out the pairs
that the ledger knows, scans the rest once, appends to the ledger, and joins the
findings back to every path and version that holds the blob.

Defined cases: null text is the empty blob; repeated rows (and null keys) each
get the blob's findings; empty input -> empty findings and an unchanged ledger;
a text may be of any length (a rule reads it whole); spans are code points, end
exclusive; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georisk.llm.common import slices, table, written
from georisk.llm.components import hub_join
from georisk.session import shared_path

LEDGER = "blob binary, rule string, rule_version string, starts array<bigint>, ends array<bigint>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` that ``valid`` lets pass."""

    name: str
    pattern: str
    valid: Callable[[re.Match], bool] = field(default=lambda m: True)
    version: str = "1"


def either_case(pattern: str) -> str:
    """ASCII letters of a pattern in either case, without Unicode's extra foldings."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


# The base rules and their least lengths.
ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
BASE = [
    Rule("assign", ASSIGN, lambda m: len(m[2]) >= 8),
    Rule("access", ACCESS, lambda m: len(m[0]) >= 16),
    Rule("hex", HEX),
]


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows for (blob, text, todo), where ``todo`` names the rules to apply."""

    def run(batches):
        compiled = {r.name: (re.compile(r.pattern).finditer, r.valid, r.version) for r in rules}
        for b in batches:
            for part in slices(b, 1):
                rows = [[], [], [], [], []]
                for blob, text, todo in zip(*(c.to_pylist() for c in part.columns)):
                    for name in todo:
                        find, valid, version = compiled[name]
                        spans = [m.span() for m in find(text) if valid(m)]
                        for col, v in zip(rows, (blob, name, version, [s for s, _ in spans], [e for _, e in spans])):
                            col.append(v)
                kinds = (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)],
                                                 names=["blob", "rule", "rule_version", "starts", "ends"])

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def scan(versions: DataFrame, ledger: str, rules: list[Rule] = BASE, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger folder does not know yet and append it there.

    Returns the input without its text but with the blob's address, and the
    ledger rows of the given rules at their present versions.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # so that a new ledger can be read
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.withColumn("__text", content).withColumn("__blob", F.unhex(F.sha2("__text", 256)))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    current = spark.read.schema(LEDGER).parquet(ledger).where(
        F.array_contains(wanted, F.struct("rule", "rule_version")))
    known = current.groupBy(F.col("blob").alias("__blob")).agg(F.collect_set("rule").alias("__known"))
    names = F.array(*[F.lit(r.name) for r in rules])
    todo = F.when(F.col("__known").isNull(), names).otherwise(F.array_except(names, "__known"))
    blobs = addressed.select("__blob", "__text").dropDuplicates(["__blob"])
    unseen = blobs.join(known, "__blob", "left").select(
        F.col("__blob").alias("blob"), F.col("__text").alias("text"), todo.alias("todo")).where(F.size("todo") > 0)
    scan_blobs(unseen, rules).write.mode("append").parquet(ledger)
    return (addressed.drop("__text", text).withColumnRenamed("__blob", "blob"),
            spark.read.schema(LEDGER).parquet(ledger).where(
                F.array_contains(wanted, F.struct("rule", "rule_version"))))


def blob_findings(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per blob: spans (start, rule number, rule, end) in order of start, then rule."""
    number = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))]), F.col("rule"))
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda z: F.struct(
        z["starts"].alias("start"), number.alias("number"), F.col("rule").alias("rule"), z["ends"].alias("end")))
    distinct = ledger.dropDuplicates(["blob", "rule", "rule_version"])  # a retried append may repeat a row
    return distinct.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, rules: list[Rule] = BASE) -> DataFrame:
    """All columns of ``paths`` plus the spans of the blob each holds; the paths of a
    blob that very many hold stay where they are."""
    paths = written(paths, "secret-paths")
    holders = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("__n"))
    facts = holders.join(blob_findings(ledger, rules), "blob", "left")
    return hub_join(paths, facts, "blob", "__n", paths.count())


def op3_secret_scan(spark, sf_dir):
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths, ledger = scan(versions, shared_path(spark, "secret-ledger"))
    found = findings(paths.select("doc_id", "blob"), ledger)
    joined = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])))
    n = [F.size(F.filter(F.transform("spans", lambda s: s["rule"]), lambda x: x == F.lit(name))).cast("long")
         .alias(f"n_{name}") for name in (r.name for r in BASE)]
    return found.select("doc_id", *n, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
