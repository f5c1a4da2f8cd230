"""Session helpers: the shared folder for durable intermediates, and code on the workers.

Intermediates that an iteration or a second pass reads again are written as Parquet tables in the
folder that the cluster names in ``spark.checkpoint.dir``.  They survive the loss of an executor, cut
the lineage, and hold only the columns that are needed.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def build_session(app: str = "lemmaworks", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is
    local.  On a cluster without that setting nothing is written: executors would not find each other's files.  The folder
    goes when the driver ends."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        told = sc.getConf().get("spark.checkpoint.dir", None)
        if told:
            _OWN[app] = f"{told.rstrip('/')}/lemmaworks-{app}"
        elif sc.master.split("[")[0] == "local":
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lemmaworks-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        atexit.register(_leave, spark, _OWN[app])
    return _OWN[app]


def _leave(spark: SparkSession, folder: str) -> None:
    """Delete all intermediates of an application."""
    try:
        delete_path(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone; what is local can still be deleted
        if folder.startswith(("file:", "/")):
            shutil.rmtree(folder.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def stage(df: DataFrame, name: str = "stage", compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (lineage ends there)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._lemmaworks_path = path
    return out


def clear_stages(spark: SparkSession) -> None:
    """Delete all intermediates written so far; results that were not written out yet can no longer be read."""
    delete_path(spark, shared_dir(spark))


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_lemmaworks_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def ship_code(spark: SparkSession) -> None:
    """Put this package on every Python worker (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_lemmaworks_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lemmaworks", os.path.relpath(full, here)))
    folder = tempfile.mkdtemp(prefix="lemmaworks-code-")  # on the driver only; Spark serves it to the workers
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "lemmaworks_code.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._lemmaworks_shipped = True


def partitions_for(df_or_spark: DataFrame | SparkSession) -> int:
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_total(df: DataFrame, order: list, value: str | None = None, into: str = "running", name: str = "running") -> DataFrame:
    """Add the inclusive running total of ``value`` (row count if None) over one global order.

    Range partitions are sorted and summed on their own; only one number for each partition reaches
    the driver, so no task ever sees the whole order.  ``order`` must be unique for a defined result.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    v = F.lit(1).cast("long") if value is None else F.col(value)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = stage(
        df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(cols)], v.alias("__v"))
        .repartitionByRange(partitions_for(spark), *[F.col(f"__o{i}") for i in range(len(cols))])
        .withColumn("__pid", F.spark_partition_id()),
        name,
    )
    sums = {r["__pid"]: r["s"] for r in ranged.groupBy("__pid").agg(F.sum("__v").alias("s")).collect()}
    kind = ranged.schema["__v"].dataType
    total, rows = 0, []
    for pid in sorted(sums):
        rows.append((pid, total))
        total = total + (sums[pid] or 0)
    if not rows:
        return df.withColumn(into, v)
    offsets = spark.createDataFrame(rows, "__pid int, __off " + ("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long"))
    w = W.partitionBy("__pid").orderBy(*[f"__o{i}" for i in range(len(cols))]).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__pid").withColumn(into, F.sum("__v").over(w) + F.col("__off"))
    return out.drop("__pid", "__off", "__v", *[f"__o{i}" for i in range(len(cols))])
