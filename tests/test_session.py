import pytest

from reposift import session


class Context:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


class Session:
    def __init__(self, master, setting=None, directory=None):
        self.sparkContext = Context(master, directory)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_setting_of_the_cluster_is_used():
    spark = Session("yarn", "hdfs://shared/cp")
    assert session.shared_dir(spark) == "hdfs://shared/cp" == spark.sparkContext.directory


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        session.shared_dir(Session("spark://host:7077"))


def test_local_session_gets_one_folder():
    spark = Session("local[2]")
    assert session.shared_dir(spark) == session.shared_dir(spark) == spark.sparkContext.directory


def test_folder_set_by_the_user_is_kept():
    assert session.shared_dir(Session("yarn", directory="hdfs://mine")) == "hdfs://mine"


def test_lineage_is_cut(spark):
    df = session.cut_lineage(spark.range(5).selectExpr("id * 2 AS x"))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5


def test_spread_leaves_many_files_alone(spark, work):
    few, many = work(), work()
    spark.range(100).coalesce(1).write.parquet(few)
    spark.range(100).repartition(12).write.parquet(many)
    plan = lambda path: session.spread(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan(few) and "RoundRobin" not in plan(many)
