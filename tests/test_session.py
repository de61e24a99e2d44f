"""Where intermediate tables go."""

import pytest

from httplens import session


class Conf:
    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


class Spark:
    def __init__(self, **settings):
        self.conf = Conf(**settings)


def test_the_folder_of_the_cluster_is_used():
    cluster = Spark(spark_master="yarn")
    cluster.conf.settings["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert session.shared_folder(cluster) == "hdfs:///shared"
    assert session.scratch_path(cluster, "x").startswith("hdfs:///shared/httplens/x-")


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_a_session_without_the_setting_is_refused(master):
    with pytest.raises(RuntimeError):
        session.shared_folder(Spark(spark_master=master))


def test_staged_rows_are_the_same(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s", "array(id) AS a")
    staged = session.stage(df, "t")
    assert staged.schema.fieldNames() == df.schema.fieldNames()
    assert sorted(staged.collect()) == sorted(df.collect())
