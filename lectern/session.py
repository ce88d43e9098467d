"""Spark session helpers.

The library never creates a session on its own inside operators; callers pass
one in.  ``local_session`` exists for tests, the bench and the smoke entry.
"""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "lectern") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset (local tests) a fresh scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="lectern-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Parquet options of tables whose rows have some MB: the writer looks at its size after every row, so that a row group, which
#: writers hold and readers decode as a whole, has a few rows.  Else it looks after 100 rows first.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker, unless the session asks for less.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Rows that hold texts or blocks reach the Python workers a few MB at a time, however many a task has."""
    now = spark.conf.get(_BATCH_CONF, None)
    size = re.fullmatch(r"(-?\d+)b?", now or "")
    if not size or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """A Python worker's free memory goes back to the system: allocators keep what the largest blocks so far took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lectern`` importable in Python workers (model and block-scoring UDFs).

    Zips the package into the session's checkpoint folder when that folder is a
    local path and registers it with ``addPyFile``; on a cluster whose
    checkpoint folder is remote, ship the package with ``--py-files`` instead.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else base
    if "://" in local or not os.path.isdir(local):
        _SHIPPED.add(id(sc))
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = os.path.join(local, "lectern-pkg.zip")
    with zipfile.ZipFile(target, "w") as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(id(sc))
