"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quarry", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is set for this session, in
    local mode only: on a cluster every machine would have one of its own, so
    there a missing setting is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
        current = context._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


#: Folders written by ``stage``, by application.
_STAGED: dict[str, list[str]] = {}


def sweep(spark: SparkSession) -> int:
    """Delete what ``stage`` wrote for this application; frames that still read it must have been written or collected."""
    from quarry.sources import files

    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files.delete(spark, path)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs now: Spark deletes them once its driver has collected its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (columnar cut); ``sweep`` deletes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, whatever their path; once per context."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-package-"), "quarry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quarry")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._quarry_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
