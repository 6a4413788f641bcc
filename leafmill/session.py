"""Session helpers: tuned session, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import gc
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on and the time zone pinned to UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and all tasks run in the
    driver's process (tests, one machine) a local folder is made and remembered
    for the session; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("leafmill.shared.dir", None)
    if own is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.conf.set("leafmill.shared.dir", own)
    return own


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that nothing has used, with the application's id in its name."""
    return f"{shared_dir(spark)}/{stem}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all that the application wrote on its way. Tables that were read from it must not be used any more."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/*-{spark.sparkContext.applicationId}-*")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(pattern) or []:
        system.delete(status.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; an error in asking is an error, not an answer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def put_file(spark: SparkSession, name: str, content: bytes) -> tuple[str, bool]:
    """Write a small file to the shared folder: (path or URI, whether it is an ordinary path).

    ``shared_dir`` is one that all machines see, so an ordinary path of it is too.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        local = target.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(content)
        return local, True
    stream = system.create(target)
    stream.write(bytearray(content))
    stream.close()
    return target.makeQualified(system.getUri(), system.getWorkingDirectory()).toString(), False


def ship(spark: SparkSession) -> None:
    """Hand the package to all workers, once per application, so that they need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("leafmill", os.path.relpath(full, root)))
    # Executors that join later get it too.
    context.addPyFile(put_file(spark, f"leafmill-{context.applicationId}-{uuid.uuid4().hex}.zip", packed.getvalue())[0])
    context._leafmill_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """``df`` read again from a reliable checkpoint, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Unlike a checkpoint the columns can then be pruned and filters pushed down.
    """
    return written_at(df, fresh_path(df.sparkSession, stem))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to a path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that is not read any more, and the shuffles of plans that nothing refers to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()  # else Spark's cleaner waits until the driver happens to collect its garbage
