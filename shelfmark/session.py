"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "shelfmark") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session you are given."""
    shuffles = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # no look at the Python stack for every column that is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; elsewhere a machine-local folder would be lost with
    its machine, so that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="shelfmark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)  # the one place where later calls find it again
    return folder.rstrip("/")


_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for all that ``cut`` writes inside; removed at the end.

    What reads from these tables has to be written or collected before.
    """
    folder = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder once and read it back from there.

    What follows starts from that table: it survives lost executors, is computed once however
    often it is used, and its size on disk lets the optimizer choose or refuse a broadcast.
    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "shelfmark")
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` where ``cut`` writes its tables."""
    return f"{_run_folder.get() or checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut``, laid out by ``key``: joins and groups on it do not move the table again."""
    spark = df.sparkSession
    name = f"shelfmark_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(parts, key).write.bucketBy(parts, key)
    writer.option("path", shared_folder(spark, name)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files stay
    return table


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows whose size the optimizer knows."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
