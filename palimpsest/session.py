"""Session construction and worker set-up."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "palimpsest") -> SparkSession:
    """A local session as the tests and the bench use it; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is not installed where they run."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


class Sessions:
    """IO16: cached versions of tables under handles, evicted by the caller's clock.

    A handle is a DataFrame that Spark caches and can compute anew, so nothing here
    must survive an executor. Handles idle for ``ttl`` seconds go with :meth:`evict`.
    """

    def __init__(self, ttl: float):
        self.ttl = ttl
        self._held: dict[str, tuple[DataFrame, float]] = {}

    def put(self, df: DataFrame, now: float) -> str:
        handle = uuid.uuid4().hex
        self._held[handle] = (df.persist(StorageLevel.MEMORY_AND_DISK), now)
        return handle

    def get(self, handle: str, now: float) -> DataFrame:
        if handle not in self._held:
            raise KeyError(f"no session {handle}")
        df, _ = self._held[handle]
        self._held[handle] = (df, now)
        return df

    def clone(self, handle: str, now: float) -> str:
        """Another handle for the same version; each goes by its own clock."""
        return self.put(self.get(handle, now).select("*"), now)

    def evict(self, now: float) -> list[str]:
        """The handles that were idle too long, which are gone now."""
        gone = [h for h, (_, last) in self._held.items() if now - last > self.ttl]
        for h in gone:
            self._held.pop(h)[0].unpersist()
        return gone
