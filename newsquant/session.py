"""Session settings shared by tests, bench and command-line use."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, for the Arrow functions."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="newsquant-"), "newsquant")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "newsquant"))
        _SHIPPED.add(app)
    return spark


def build_session(app: str = "newsquant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; `conf` overrides any setting."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="newsquant-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting by which the shuffle files of a command go once it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def free_shuffles(spark: SparkSession) -> Iterator[None]:
    """What commands shuffle meanwhile goes once each has ended."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The copy survives the loss of any executor, later plans start from it,
    and being Parquet it keeps column pruning and an exact size for joins.
    What was shuffled to make it is not kept beside it.
    """
    path = f"{shared_folder(df.sparkSession)}/newsquant-{uuid.uuid4().hex}"
    with free_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the copies that `cut_lineage` wrote for these frames, once nothing reads them any more; others are left alone."""
    for df in frames:
        path = getattr(df, "_landed_at", None)
        if path is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
