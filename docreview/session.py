"""Session set-up and staging."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docreview")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of about BATCH_BYTES. Spark's own
    bounds, 10,000 rows or 64 MB, would have long texts held by the JVM and by the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: `spark.checkpoint.dir`, which a cluster sets to shared
    storage. Where it is unset (a local session in tests) a folder of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="docreview-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once and read it back, for a result that several branches read.

    A written table cuts the lineage and survives lost executors, which a cache does not.
    Runs one job. `release` removes the table when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(*tables: DataFrame) -> None:
    """Remove tables that `stage` wrote, given as it returned them; others are left alone.

    Only the caller knows that no lazy result reads them any more."""
    for table in tables:
        if path := getattr(table, "_staged_at", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
