import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from georisk.session import build_session
    s = build_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def labelled_small(spark):
    """Labelled slots of the sf0.001 fixture, checkpointed."""
    from georisk.operators import cells as C
    from georisk.operators import tree as T
    from georisk.sources.incidents import incidents_from_tables
    return T.materialize(C.label_cells(C.box_agg(incidents_from_tables(spark, SF0001))))


@pytest.fixture(scope="session")
def labelled_mid(spark):
    """Labelled slots of the sf0.01 fixture (all three classes occur), checkpointed."""
    from georisk.operators import cells as C
    from georisk.operators import tree as T
    from georisk.sources.incidents import incidents_from_tables
    return T.materialize(C.label_cells(C.box_agg(incidents_from_tables(spark, SF001))))
