"""Tables that a plan writes once and reads several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``, or the checkpoint folder set on its context.

    Where neither is set, a session in one process (``local``) gets a temporary folder; on a cluster that is an error, as
    a folder of one machine is no use there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows reads it by column, however often, and never computes it again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
