"""Incremental intake of price files: a file stream with a checkpoint, and a queue of the files that failed.

Each file is parsed once; a batch that is retried overwrites its own folders. A file that can't be read yet (cut off, damaged, empty)
goes to the queue, which each batch leaves behind as a whole, and is read again, as it is by then, with a later batch or by drain().
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chargelens.operators.staging import staged
from chargelens.sources import price_files, ranges

FILES = "path string, modificationTime timestamp, length long, content binary"
QUEUE = "path string, attempts int, due double, left double"
#: Statuses of files that may be whole later on.
MAY_MEND = ("skip:bad_zip", "skip:unknown_zip", "skip:unreadable", "skip:empty", "skip:bad_csv", "skip:short_csv")
OWNER = r"([^/]+)/[^/]+$"


def stream(spark: SparkSession, folder: str, files_per_batch: int = 64, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def queue(spark: SparkSession, out: str, but: int | None = None) -> DataFrame:
    """(path, attempts, due): the files that failed, as the last batch left them (the last other than ``but``). Files out of attempts have no due time."""
    try:
        states = spark.read.schema(f"{QUEUE}, batch long").parquet(f"{out}/queue")
    except AnalysisException:
        return spark.createDataFrame([], "path string, attempts int, due double")
    if but is not None:
        states = states.where(F.col("batch") != but)
    last = states.agg(F.max("left")).first()[0]
    return states.where((F.col("left") == last) & F.col("path").isNotNull()).select("path", "attempts", "due")


def _batch(new: DataFrame | None, spark: SparkSession, out: str, number: int, owner: str, attempts: int, wait: float) -> None:
    """Parses ``new`` files and those of the queue that are due, and leaves the queue of what failed. Run again under its number, it begins from the queue that was there before."""
    now = time.time()
    known = staged(queue(spark, out, number))
    due = staged(ranges.contents(known.where(F.col("due") <= now).select("path", F.lit(0).cast("long").alias("length")), gone_is_empty=True).withColumn("length", F.length("content").cast("long")))
    source = due if new is None else new.select("path", "length", "content").unionByName(due.join(new.select("path"), "path", "left_anti"))
    owners = source.select("path", F.regexp_extract("path", owner, 1).alias("ccn"))
    gross, negotiated, log = price_files.parse(source, owners)
    log = staged(log)
    for name, rows in (("gross", gross), ("negotiated", negotiated), ("log", log)):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    failed = log.where(F.col("status").isin(*MAY_MEND)).select("path").distinct().join(known.select("path", F.col("attempts").alias("before")), "path", "left")
    tried = (F.coalesce("before", F.lit(0)) + 1).cast("int")
    failed = failed.select("path", tried.alias("attempts"), F.when(tried < attempts, now + wait * F.pow(F.lit(2.0), tried - 1)).alias("due"))
    waiting = known.join(log.select("path").distinct(), "path", "left_anti")
    state = failed.unionByName(waiting).unionByName(spark.createDataFrame([(None, None, None)], "path string, attempts int, due double"))  # a row even where none failed
    state.withColumn("left", F.lit(now)).write.mode("overwrite").parquet(f"{out}/queue/batch={number}")


def start(files: DataFrame, out: str, checkpoint: str, owner: str = OWNER, attempts: int = 3, wait: float = 3600.0) -> StreamingQuery:
    """Parses what is new and stops. ``out`` gets ``gross``, ``negotiated`` and ``log`` with a folder a batch; ``owner`` finds the hospital in a path.

    The batch's folder is overwritten, so a failed batch that runs again leaves no row twice. A file that failed is tried ``attempts`` times, first after ``wait`` seconds
    and then after twice as long each time; it has left no row before, so none is there twice. Files end in any order."""

    def batch(df: DataFrame, number: int) -> None:
        _batch(df, df.sparkSession, out, number, owner, attempts, wait)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, out: str, owner: str = OWNER, attempts: int = 3, wait: float = 3600.0) -> int:
    """Tries the files of the queue that are due, where no new file brings a batch. Returns how many; its folders are batch=-1, -2 and so on."""
    count = queue(spark, out).where(F.col("due") <= time.time()).count()
    if count:
        lowest = spark.read.schema(f"{QUEUE}, batch long").parquet(f"{out}/queue").agg(F.min("batch")).first()[0]
        _batch(None, spark, out, min(lowest, 0) - 1, owner, attempts, wait)
    return count
