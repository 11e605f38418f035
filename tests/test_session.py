"""Where cut tables go."""

from types import SimpleNamespace

import pytest

from formline.session import materialize, shared_folder


def stub(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{master}")
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_named_folder_is_used():
    assert shared_folder(stub("yarn", "hdfs://x/ckpt")) == "hdfs://x/ckpt"


def test_cluster_without_folder_stops():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(stub("yarn"))


def test_local_session_gets_one_folder():
    assert shared_folder(stub("local[2]")) == shared_folder(stub("local[2]"))


def test_materialized_rows_are_frozen(spark):
    from pyspark.sql import functions as F
    df = materialize(spark.range(100).withColumn("r", F.rand()))
    assert sorted(df.collect()) == sorted(df.collect()) and df.columns == ["id", "r"]


def test_stored_tables_follow_their_files(spark, tmp_path):
    from formline.session import stored_once
    path = str(tmp_path / "t")
    built = []

    def get():
        return stored_once(spark, lambda: (built.append(1), spark.read.parquet(path))[1], path, "t", inputs=[path]).count()

    spark.range(3).write.parquet(path)
    assert (get(), get(), len(built)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert (get(), get(), len(built)) == (5, 5, 2)
