import pytest
from pyspark.sql import functions as F

from loomspark import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf(conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(**{"spark.master": master}))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_session_gets_one(master):
    own = Session(**{"spark.master": master})
    assert session.shared_dir(own).startswith("file://") and session.shared_dir(own) == own.conf["spark.checkpoint.dir"]


def test_scratch_is_dropped(spark, tmp_path):
    rows = session.materialize(spark.range(3).withColumn("x", F.lit("a")), "table")
    assert rows.count() == 3 and session.scratch_dir(spark) in rows.inputFiles()[0].replace("file:///", "file:///")
