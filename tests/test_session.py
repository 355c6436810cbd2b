"""Where intermediates go: the named folder, a shared warehouse, or an error, never a disk that only one machine sees."""

import pytest

from hearthspan.session import scratch, shared_folder


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def session(master, warehouse, folder=None):
    found = Session()
    found.conf.update({"spark.master": master, "spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": folder} if folder else {}))
    return found


def test_the_named_folder_wins():
    assert shared_folder(session("yarn", "file:/w", "hdfs://c/shared")) == "hdfs://c/shared"
    assert scratch(session("yarn", "file:/w", "hdfs://c/shared"), "x").startswith("hdfs://c/shared/x-")


def test_a_local_warehouse_serves_one_machine_only():
    assert shared_folder(session("local[8]", "file:/w/")) == "file:/w/_shared"
    assert shared_folder(session("spark://m:7077", "s3a://b/w")) == "s3a://b/w/_shared"
    for master, warehouse in (("yarn", "file:/w"), ("spark://m:7077", "/w"), ("local-cluster[2,1,1024]", "file:///w"), ("k8s://m", "spark-warehouse")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master, warehouse))
