"""Session settings and small helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lodestone import session

#: Arrow batches of text stay near this size whatever the row length, so that a Python worker's memory is bounded.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20
#: Whether a query's shuffle files go with its end.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and bounds the Arrow batches of this session; results don't depend on it."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests) a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is deleted when the query ends, and not when the driver happens to collect its
    garbage. For queries whose result is all that is used of them."""
    before = spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table written in the shared folder, and its path, for ``forget``. Its shuffles are deleted."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def size_in_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` holds: Catalyst's estimate where all comes from one file scan; else, as estimates of other
    plans may be far off, a third of the bytes of its texts, by one aggregate."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "LogicalRelation":
        return int(str(plan.stats().sizeInBytes()))
    texts = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`")).cast("bigint")), F.lit(0)) for c in texts]
    row = df.agg(F.count("*").alias("n"), sum(lengths, F.lit(0)).alias("size")).first()
    return int(row["n"]) * 8 * len(df.columns) + int(row["size"]) // 3


def parts(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """So many partitions or buckets that each has about this share of the input; grows with the input, without a cap."""
    return max(least, math.ceil(size_in_bytes(df) / bytes_each))
