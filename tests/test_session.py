"""Checkpoint folder rules and stored tables."""

import pytest

from labelsift.session import ensure_checkpoint_dir, is_local, stored


class _Context:
    def __init__(self, master):
        self.master, self.set_to = master, None

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, path):
        self.set_to = path

    def getConf(self):
        return self

    def get(self, key, default=None):
        return default


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.conf = self.sparkContext


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_without_a_shared_folder_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(master))


def test_local_masters_get_a_scratch_folder():
    for master in ("local", "local[4]", "local[*, 3]"):
        assert is_local(master)
        assert ensure_checkpoint_dir(_Session(master))


def test_stored_table_reads_back(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k long, t string")
    back = stored(df)
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == [(1, None), (2, "x")]
