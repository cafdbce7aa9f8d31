"""Session defaults and the shared folder that operators write intermediate tables to."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map={**defaults, **conf}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the workers, once per session, wherever they run and whatever their search path is."""
    context = spark.sparkContext
    if getattr(context, "_newsloom", False):
        return
    block = io.BytesIO()
    root = Path(__file__).parent
    with zipfile.ZipFile(block, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = shared_dir(spark, "newsloom") + ".zip"
    write_bytes(spark, path, block.getvalue())
    context.addPyFile(path)
    context._newsloom = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, visible to every executor.

    Only a local master without that setting falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder written by materialise, wherever its file system is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_bytes(spark: SparkSession, path: str, block: bytes) -> None:
    """Writes a small file to the shared folder, wherever its file system is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(block)
    out.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Marks df for broadcast only after measuring that it has at most max_rows rows and, written out, max_bytes bytes; a larger one is joined by shuffle."""
    size = F.sum(F.length(F.to_json(F.struct("*"))).cast("bigint"))
    rows, length = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and length <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where a small input in few files would leave most of them idle; at scale df as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores << 22 and len(df.inputFiles()) < cores else df
