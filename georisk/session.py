"""Session construction and shared output locations.

Everything that has to land on a file system (models, CSV exports, lineage cuts)
goes below the folder the cluster names in ``spark.checkpoint.dir``. That folder
is shared by all executors on a real cluster; a machine-local temporary folder is
only created when the setting is missing *and* the master is local (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for sessions this library creates (tests, bench, jobs); a caller's
# ``extra`` entries replace them. Sessions created elsewhere are used as they are.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Let the JIT compile large generated methods (wide whole-stage-codegen
    # stages otherwise run interpreted once a method passes 8000 bytecodes).
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "georisk", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, total_cores: int, waves: int = 4) -> dict[str, str]:
    """Split and shuffle sizing from the input size and the cluster's cores.

    Scan splits aim at ``waves`` rounds of tasks over all cores, clamped to
    [16 MB, 1 GB]: every scan here streams vectorized batches into a partial
    aggregate whose hash map is bounded by the grid, so large splits only cut
    task overhead (100 TB on 8,000 cores → 1 GB splits, ~100k tasks). Shuffles
    carry partial aggregates, so a few partitions per core with AQE coalescing
    toward 64 MB is enough.
    """
    split = max(16 << 20, min(1 << 30, input_bytes // max(1, total_cores * waves)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.files.openCostInBytes": str(min(split, 4 << 20)),
        "spark.sql.shuffle.partitions": str(max(8, 2 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 << 20),
    }


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The cluster-shared folder from ``spark.checkpoint.dir``.

    Falls back to a fresh temporary folder only under a local master; on a
    cluster an unset value is an error, never a silent local path.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="georisk-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique location below the shared root (never reused, never cleared)."""
    return f"{shared_root(spark)}/georisk/{name}-{uuid.uuid4().hex}"
