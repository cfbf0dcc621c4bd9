"""Spark session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the library's results depend on; sizing is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Spark's limit for the rows of one Arrow batch, and what a chain of Python stages sets it to.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22
#: Spark's setting that deletes a query's shuffle files as soon as the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; extra ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Spark's file server hand this package to every Python worker (once per application)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="gleanery-")) / "gleanery.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for module in sorted(package.rglob("*.py")):
                bundle.write(module, module.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Spark send texts to Python in batches of BATCH_BYTES at most, unless the session has a lower limit.

    By default a batch is up to 10,000 rows and 64 MB, which each task's JVM and worker then hold more than once.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_LIMIT)) > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return spark


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete what the writes in this block shuffled as soon as each is done.

    By default the files stay until the driver happens to collect its garbage, which over a chain of writes may be never.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def scratch_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins; only when it is unset does the caller's own
    fallback (a folder next to the index it is writing) take its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no shared fallback was given")
    return fallback.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go. A machine's own folder takes its place only where one machine is all there is."""
    local = spark.sparkContext.master.startswith("local")
    return scratch_root(spark, tempfile.mkdtemp(prefix="gleanery-") if local else None)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for a result that several parts of one query need."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for per-row work on a table stored in too few splits.

    For plain scans (asking a plan with shuffles for its partitions would run
    them). A large table already has more splits than cores and passes through
    untouched; only a small file with a single row group is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
