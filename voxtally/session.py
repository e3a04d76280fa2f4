"""Session helpers: a local session for tests and benchmarks, checkpoint folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(app: str = "voxtally", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the context's, else ``spark.checkpoint.dir``.

    Only a local session without either gets a temporary folder of its own: a machine-local
    folder would not be shared by the executors of a cluster.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="voxtally-checkpoint-")
    context.setCheckpointDir(configured)
    folder = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def new_table_path(spark: SparkSession) -> str:
    """A fresh folder name for a table under the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, written once as Parquet under the checkpoint folder and read back.

    For rows that several passes read: what made them runs once, later passes read only the
    columns they need, and lost executors cost nothing but their tasks. The folder belongs to
    the application; it is deleted when the driver's JVM ends in good order.
    """
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_table(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows of a table that should be small, None if it is not.

    At most ``max_rows + 1`` rows are fetched to find out.
    """
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= max_bytes else None


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Evaluate a table that should be small and mark it for broadcasting if it really is.

    Within the bound the result is a local table with a broadcast hint, so the aggregate behind
    it runs once. Beyond it the table comes back as it was, without a hint: Spark then shuffles
    both sides and AQE splits skewed keys, with the same result.
    """
    table = bounded_table(df, max_rows, max_bytes)
    return df if table is None else broadcast_table(df, table)


def local_table(df: DataFrame, table: pa.Table) -> DataFrame:
    """The fetched rows of ``df`` as a table of their own."""
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def broadcast_table(df: DataFrame, table: pa.Table) -> DataFrame:
    return F.broadcast(local_table(df, table))
