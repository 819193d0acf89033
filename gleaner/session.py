"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="gleaner-package-")) / "gleaner.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))  # Spark sends it to every executor
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one in the warehouse, which is shared too, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(
            sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        )
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a stream's results and state."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` to reliable storage, so a lost executor never recomputes what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, written once and measured, with a broadcast hint if it is within `max_bytes`; otherwise the join is Spark's.

    The measure is the length of the rows as JSON, null fields aside.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if measure(df) <= max_bytes else df


def measure(df: DataFrame) -> int:
    """Bytes of the rows as JSON, null fields aside."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")).first()["size"] or 0


@contextmanager
def reading_parts(spark: SparkSession, size: int) -> Iterator[None]:
    """What is written inside reads files in parts of at most `size` bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows that are little to read and much to work on, dealt to as many tasks as a shuffle has, however small they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def take_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a side table that must stay small; refuses instead of flooding the driver."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
