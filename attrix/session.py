"""Session helpers shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session configured for analytic workloads.

    On a cluster the deployment supplies master, memory and the shared
    checkpoint folder; here we only fill in what is unset.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("attrix")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ATTRIX_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; a private folder is
    set only when nothing is configured and the master is local (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="attrix-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrix-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict:
    """Lazy parquet handles for the fixture tables (no data is read here)."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``attrix`` importable in Python workers (``applyInPandas`` /
    ``mapInPandas`` functions reference its modules).

    The package's sources are zipped once per SparkContext and distributed
    with ``addPyFile`` (Spark's file server puts them on every executor's
    Python path).  A deployment that installs the package on the executors
    does not need this; calling it anyway is harmless."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import attrix

    root = os.path.dirname(os.path.abspath(attrix.__file__))
    staging = tempfile.mkdtemp(prefix="attrix-pkg-")
    path = os.path.join(staging, "attrix.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def partitions_for(rows: int, rows_per_partition: int = 200_000, cap: int | None = None) -> int:
    """Partition count for a derived table of ``rows`` rows: about
    ``rows_per_partition`` rows each, at least 1 (small model tables should
    not inherit hundreds of shuffle partitions; big ones still spread)."""
    n = max(1, -(-int(rows) // rows_per_partition))
    return min(n, cap) if cap else n


def spread(df: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    """``df`` dealt evenly over the cluster's cores for a job that passes over it again and
    again.  A Parquet split holds whole row groups, so millions of narrow rows can be one
    task; a table of up to ``rows_per_partition`` rows stays as it is read."""
    rows = df.count()
    most = max(4 * df.sparkSession.sparkContext.defaultParallelism, partitions_for(rows, 10 * rows_per_partition))
    parts = partitions_for(rows, rows_per_partition, most)
    return df if parts == 1 else df.repartition(parts)
