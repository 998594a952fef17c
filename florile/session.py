"""Session helper for tests, benches and examples."""

import os
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import SparkSession


def session(cpus: int | None = None, memory: str = "8g", shuffle: int | None = None) -> SparkSession:
    """A local session. On a cluster the caller brings its own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("florile")
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder's name in the one that spark.checkpoint.dir gives, which goes when the driver ends. Where that is unset, a local one in local mode (tests); a cluster has to set it."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    place = f"{(place or mkdtemp(prefix='florile-')).rstrip('/')}/florile/{name}-{uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place
