"""The shared folder of a session, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local (tests, a laptop) a local folder is made
    and named in the session, and removed when Python ends. On a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="slatewise-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not used before, below the shared folder."""
    return f"{shared_dir(spark)}/slatewise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Survives the loss of any executor, unlike cached blocks or a local
    checkpoint, and gives the optimiser real sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_file(spark: SparkSession, part: str, path: str) -> None:
    """Put ``part`` in the place of ``path`` by one rename that overwrites, so that there is always a whole file."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(hadoop.Path(part), hadoop.Path(path), options)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
