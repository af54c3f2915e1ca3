"""Session helpers used by tests, the bench and the examples.

Library code never creates a session; it uses the one it is given. The
checkpoint directory is read from the session (``spark.checkpoint.dir``, the
shared folder a cluster names); a local default is set only when none is
configured, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for functions
    that run in their Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="vintage-code-")) / "vintage_code.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(at))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "vintage") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VINTAGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory. When it has none, a local
    run (tests, one machine) gets a scratch folder; on a cluster executors
    would write to their own disks, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="vintage-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def dealt(df, *key):
    """``df`` dealt out by ``key`` into a number of partitions of its own: for
    groups that are small in bytes, by which the run-time planner would put
    them together, but not in the rows or the work made of them."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *key)


def materialize(df):
    """Write a small, reused intermediate (cell tables, matrices) once to the
    checkpoint directory and cut its lineage, so later branches and loop
    rounds read it instead of re-deriving it from the transactions, and a lost
    executor does not send them back to the raw data."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df):
    """Write an intermediate that is large, or whose size the planner should
    know, once as Parquet below the checkpoint directory and read it back:
    columns are compressed, readers take only those they need, and a join
    broadcasts it only below Spark's threshold."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
