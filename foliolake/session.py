"""Session construction and the two lineage helpers every iterative operator uses."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliolake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master with none configured;
    on a cluster a machine-local folder would not survive a lost executor, so
    that case raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliolake-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan over the cores when its files yield fewer tasks.

    For operators that spend long on each row. Large inputs have more tasks
    than cores and pass unchanged; ``scan`` must not contain a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever the driver was started.

    Workers see the working directory, PYTHONPATH and installed packages. When
    the package lies elsewhere (only the driver's sys.path has it), a local
    session gets it as a file of the session. On a cluster the package must be
    installed or on PYTHONPATH, as any library.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_foliolake_shipped", False) or not sc.master.startswith("local[") and sc.master != "local":
        return
    sc._foliolake_shipped = True
    if any(p and Path(p).resolve() == root for p in seen) or str(root).startswith(sys.prefix):
        return
    path = Path(tempfile.mkdtemp(prefix="foliolake-zip-")) / "foliolake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "foliolake").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
