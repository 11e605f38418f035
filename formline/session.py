"""Session helpers: a local session for tests and benches, and durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "formline") -> SparkSession:
    """A single-machine session; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the one named in ``spark.checkpoint.dir``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return os.path.join(shared_folder(spark), f"out-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, freezes non-deterministic
    columns, and gives the optimizer true sizes for its join choices.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"formline-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stored: dict[tuple, tuple[tuple, DataFrame]] = {}


def files_state(spark: SparkSession, *paths: str) -> tuple:
    """Number of files under the paths and a hash of their names, times and sizes; reads no content."""
    listed = spark.read.format("binaryFile").load(list(paths))
    return tuple(listed.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(path, modificationTime, length))")).first())


def stored_once(spark: SparkSession, build, *key: str, inputs: list[str], write: bool = True) -> DataFrame:
    """The table built by ``build()`` from the files ``inputs``, written on first use in this
    application, and again when those files have changed. What ``build`` has written itself need not be written twice."""
    full, state = (spark.sparkContext.applicationId, *key), files_state(spark, *inputs)
    if full not in _stored or _stored[full][0] != state:
        _stored[full] = (state, materialize(build()) if write else build())
    return _stored[full][1]
