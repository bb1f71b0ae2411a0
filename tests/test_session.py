"""Session helpers: shared folder from spark.checkpoint.dir, sizing."""

from georisk.session import scale_conf, shared_path, shared_root


def test_shared_paths_live_under_checkpoint_dir(spark):
    root = shared_root(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert root == configured.rstrip("/")
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(root + "/georisk/x-")


def test_scale_conf_bounds():
    local = scale_conf(40 << 20, 8)
    assert int(local["spark.sql.files.maxPartitionBytes"]) == 16 << 20
    big = scale_conf(100 << 40, 8000)
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 1 << 30
    assert int(big["spark.sql.shuffle.partitions"]) == 16000
    mid = scale_conf(1 << 40, 1000)
    assert 16 << 20 < int(mid["spark.sql.files.maxPartitionBytes"]) < 1 << 30
