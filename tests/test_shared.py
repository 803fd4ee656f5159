from types import SimpleNamespace

import pytest

from marketspark.sources import shared


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_folder_is_the_clusters():
    assert shared.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:1", "local-cluster[3,2,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master))
    assert shared.shared_dir(session("local[4]")).startswith("file://")


def test_tables_are_written_read_and_dropped(spark):
    from pathlib import Path

    t = shared.materialise(spark.range(5), "five")
    where = Path(t._marketspark_path.removeprefix("file://"))
    assert t.count() == 5 and where.exists()
    shared.drop_tables(t)
    assert not where.exists()
    shared.drop_tables(t)  # once more does no harm
