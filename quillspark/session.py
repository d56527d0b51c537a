"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this engine assumes; none of them depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter makes the session."""
    b = SparkSession.builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for Python workers that were started elsewhere than beside it."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    beside = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if getattr(sc, "_quillspark", False) or os.path.realpath(root) in beside:
        return
    folder = tempfile.mkdtemp(prefix="quillspark-")  # on the driver only, which serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "quillspark"), "zip", root, "quillspark"))
    sc._quillspark = True


def tune(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings results depend on (the time zone); leaves sizing to the cluster."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"quillspark-{os.getpid()}")
    return "file://" + root


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        if spark._sc is not None and spark._sc._jsc is not None:
            _remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
