"""SparkSession factory with the settings that every plan of this library expects."""

from __future__ import annotations

import os
import threading

from pyspark.sql import SparkSession

#: Queries may start in several threads of one session.
_SHIPPING = threading.Lock()


def get_session(app: str = "ledgerloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """Session for local runs; on a cluster, pass your own session to the operators instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def short_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Arrow batches of few rows: texts are long, and a batch is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever their working directory and path. Once per context."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    with _SHIPPING:
        if getattr(context, "_ledgerloom_shipped", False):
            return
        at = tempfile.mkdtemp(prefix="ledgerloom-package-")
        here = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{at}/ledgerloom", "zip", here.parent, here.name))
        context._ledgerloom_shipped = True
