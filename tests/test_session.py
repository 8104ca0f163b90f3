import pytest

from accesslens.session import shared_folder


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """The two parts of a session that `shared_folder` looks at."""

    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": setting}


def test_the_cluster_setting_comes_first():
    spark = Session("spark://host:7077", "hdfs:///shared/", "hdfs:///other")
    assert shared_folder(spark, "x").startswith("hdfs:///shared/x-")


def test_then_the_context_folder():
    assert shared_folder(Session("yarn", None, "hdfs:///other"), "x").startswith("hdfs:///other/x-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn"), "x")


def test_local_sessions_get_one_temporary_folder():
    spark = Session("local[4]")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_real_session(spark):
    assert "/x-" in shared_folder(spark, "x")
