"""Session, table access and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Tables the driver generates; each is one parquet file per scale factor.
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "parley") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session: every operator only needs ``SparkSession.active``."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


#: Bytes of an Arrow batch: whole texts make row counts a poor measure.
ARROW_BATCH = "2m"
#: Rows the Parquet reader decodes at once: a batch of whole texts is one
#: array on the heap, grown by doubling.
READ_ROWS = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """A session ready for this package's functions in Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the session's executors (once per context), so
    functions that run in Python workers find it wherever they start."""
    sc = spark.sparkContext
    if not getattr(sc, "_parley_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="parley-", suffix=".zip")    # read by the driver's file server only
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("parley", os.path.relpath(full, here)))
        sc.addPyFile(path)
        sc._parley_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes
    filters into this scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that yields fewer partitions than the
    parallelism (a small file with one row group), so per-row text work
    uses every core. Frames spread on the same key line up, so a later join
    between them on that key needs no further shuffle. A large input
    already has enough splits and is left unchanged."""
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys)


def dealt(df: DataFrame, scan: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` in eight times as many parts as ``scan``,
    the table read for it, has splits. What is exploded from a row then lies together: grouping by
    the keys, or by more columns, shuffles none of the copies."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, 8 * scan.rdd.getNumPartitions()), *keys)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (session
    or context configuration) or an already registered checkpoint folder.
    Only when none is set and the session runs in one process (local tests)
    a folder under the system temp dir is created and registered, so
    ``DataFrame.checkpoint()`` works too; on a cluster that is an error.
    """
    sc = spark.sparkContext
    conf = (spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir", None)
            or sc.getCheckpointDir())
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="parley-scratch-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_dir(spark)}/{stem}-{uuid.uuid4().hex[:12]}"


#: Spark drops a finished execution's shuffle files when this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for what is planned and run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it is done."""
    return settings(spark, {_CLEANUP: "true"})


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Write a step's result below the shared folder and read it again, so
    later steps start from the table; the step's shuffle files go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a
    local checkpoint: executors may be lost)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
