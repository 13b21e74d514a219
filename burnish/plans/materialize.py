"""Cut lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="burnish-ckpt-"))
    else:
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that executors write and read, next to the checkpoints.

    It is deleted when the application ends.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    Columns are written by position, so any names will do; those without a type stay literals.
    """
    folder = shared_folder(df.sparkSession, name)
    places = {f.name: f"c{i}" for i, f in enumerate(df.schema)}
    plain = df.toDF(*places.values())
    typed = [f.name for f in plain.schema if not isinstance(f.dataType, T.NullType)]
    plain = plain.select(*typed)
    plain.write.parquet(folder)
    back = df.sparkSession.read.schema(plain.schema).parquet(folder)
    return back.select(
        *[(F.col(p) if p in typed else F.lit(None)).alias(c) for c, p in places.items()]
    )
