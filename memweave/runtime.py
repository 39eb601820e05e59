"""Where jobs may write: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of a batch that goes to Python: both sides hold a few of them, for each core.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master, whose driver and executors are one machine, may do without."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, so a lost executor costs one stage, not the
    whole chain.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    _written(df.sparkSession).add(path)
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out to all cores by ``key``, for work that is heavy for each row.

    Spark deals by bytes: rows that compress well, or whose texts are made of a few
    columns, are one task however many they are, and so is all that reads them later.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def _written(spark: SparkSession) -> set[str]:
    context = spark.sparkContext
    if not hasattr(context, "_memweave_written"):
        context._memweave_written = set()
    return context._memweave_written


def track(spark: SparkSession, path: str) -> None:
    """``clear`` deletes this folder too."""
    _written(spark).add(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written(spark).discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written in the shared folder, once their results are no longer read."""
    for path in sorted(_written(spark)):
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what is written by ``materialize`` meanwhile; results must stand elsewhere by then."""
    before = set(_written(spark))
    try:
        yield
    finally:
        for path in sorted(_written(spark) - before):
            _delete(spark, path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned and nothing reads any more."""
    _delete(df.sparkSession, df.written_at)
    # Spark drops a finished job's shuffle files when the driver has collected the plan that made them
    df.sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark context, and the session batches of few bytes."""
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_memweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="memweave-")) / "memweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._memweave_shipped = True
