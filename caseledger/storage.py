"""Where intermediate tables live, and how lineage is cut.

Both use the folder named by ``spark.checkpoint.dir``, which must be visible to every
executor. Without that setting they use a folder inside the session's warehouse; on a
cluster that must then be a shared one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The named folder; where none is named, one inside the warehouse, unless that is a
    machine's own folder and the session a cluster's."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        if not sc.master.startswith("local") and named.startswith(("file:", "/")):
            raise ValueError(f"set spark.checkpoint.dir: {named} is on the driver's machine only")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage into replicated storage, so a lost executor costs one task only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        remove(table.sparkSession, folder)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when their query ends.

    Otherwise they stay until the driver happens to collect its garbage, so the many
    queries of a loop would hold them side by side.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def order_arrival(spark: SparkSession, folder: str) -> None:
    """Date a written table's files in the order of their names.

    A stream takes files up by their time, and tasks that write side by side finish in any
    order; those of a sorted table are named in its order.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = {s.getPath().getName(): s for s in files.listStatus(path)}
    names = sorted(n for n in listed if not n.startswith(("_", ".")))
    first = max((listed[n].getModificationTime() for n in names), default=0) - 1_000 * len(names)
    for at, name in enumerate(names):
        files.setTimes(listed[name].getPath(), first + 1_000 * at, -1)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
