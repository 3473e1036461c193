"""Tables in the shared folder, and small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import share_package

#: Used only by local sessions that name no spark.checkpoint.dir, as in tests.
_OWN: dict[str, str] = {}
#: Links from which an id is a hub: its links are joined with a broadcast label.
HUB_LINKS = 100_000

#: Without its native library Hadoop runs a chmod process for each file and folder that it makes on a local path, and
#: a process that a JVM launches counts as large as the JVM until it has begun. So tables get no mark of success and no
#: checksum files (Parquet has its own), and :func:`stored` makes their folders.
QUIET = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: The separators of words: space, and the code points 9 to 13.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster must name it; a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _OWN.setdefault(app, tempfile.mkdtemp(prefix="palimpsest-"))
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The lineage ends there: a lost executor costs the reading tasks alone. The
    folder goes when the application ends, or earlier through :func:`dropped`.
    """
    spark = share_package(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    local = urlsplit(path)
    if local.scheme in ("", "file"):
        os.makedirs(f"{local.path}/_temporary/0/_temporary")
    df.write.mode("append").options(**QUIET).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_plus_one(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def components(links: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(id, class_id): the least id that each id reaches over ``links`` (a, b).

    Rounds of minimum labels with pointer jumping over the linked ids alone. Links
    of a hub (``HUB_LINKS`` and more) would meet in one task to get its label; the
    hubs' labels, of which there are fewer than a ``HUB_LINKS``th of the links, are
    broadcast instead.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, f"{name}-edges")
    hubs = stored(edges.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= HUB_LINKS).select(F.col("b").alias("id"), F.lit(True).alias("hub")), f"{name}-hubs")
    some = hubs.count() > 0
    if some:
        marked = stored(edges.join(F.broadcast(hubs.withColumnRenamed("id", "b")), "b", "left"), f"{name}-edges")
        dropped(edges)
        edges = marked
    label = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), f"{name}-label")

    def of_neighbours(label: DataFrame) -> DataFrame:
        if not some:
            return edges.join(label, edges.b == label.id).select("a", "label")
        near = edges.where("hub is null").join(label, F.col("b") == label.id).select("a", "label")
        of_hubs = label.join(F.broadcast(hubs.select("id")), "id", "left_semi")
        return near.unionByName(edges.where("hub").join(F.broadcast(of_hubs), F.col("b") == of_hubs.id).select("a", "label"))

    for _ in range(most_rounds):
        near = of_neighbours(label).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("label").alias("beyond"))
        after = stored(
            step.join(jump, "low", "left").select("id", "old", F.coalesce(F.least("low", "beyond"), "low").alias("label")),
            f"{name}-label",
        )
        moved = after.where("label <> old").limit(1).count()
        dropped(label)
        label = after
        if not moved:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    dropped(edges, hubs)
    return label.select("id", F.col("label").alias("class_id"))
