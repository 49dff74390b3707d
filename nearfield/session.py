"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "nearfield", cores: int | str = "*", shuffle: int = 8, memory: str = "16g") -> SparkSession:
    """A session for one machine. On a cluster use the session the cluster gives you."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only where the cluster names none is one made up, which is right for
    local masters alone: a cluster session without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="nearfield-")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/nearfield/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems, wherever ``path`` is; a missing one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def rename_folder(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name on the file system it is on."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    if not make(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(make(path), make(to)):
        raise RuntimeError(f"{path} could not be renamed")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than there are cores.

    A small file is one partition whatever the number of cores; dealing its rows
    out by ``key`` costs one small shuffle, after which grouping by the key needs
    none. An input with enough partitions is left alone, so a large table is
    never moved for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor does not replay earlier rounds."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    with shuffles_removed(spark):
        return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind: what they write stands elsewhere, and only that is read again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class Rounds:
    """A table that rounds rewrite: each state is written to the shared folder and the one before it goes.

    Cuts the lineage as ``cut_lineage`` does. Of all states only the last can be read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def keep(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, scratch_path(self.spark, self.name)
        with shuffles_removed(self.spark):
            df.write.parquet(self.path)
        if before is not None:
            remove_folder(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)

    def end(self) -> None:
        """Remove the last state too."""
        if self.path is not None:
            remove_folder(self.spark, self.path)
            self.path = None


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nearfield-ship-")) / "nearfield.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
