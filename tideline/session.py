"""Session set-up shared by the benchmark, the tests and stand-alone use."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(app: str = "tideline", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named in ``spark.checkpoint.dir``.

    Only a session whose executors run inside the driver gets a local folder where
    none is named; on a cluster it would lie on another disk for each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder under master {master}")
        base = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, whose Python workers import it; once per application."""
    context = spark.sparkContext
    if any(name.endswith("/tideline.zip") for name in context.listFiles):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
