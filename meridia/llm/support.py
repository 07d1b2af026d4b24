"""Spark helpers shared by the operators: tables, materialised cuts, size-checked joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of (id) or (id, small value) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def small_batches(spark: SparkSession, rows: int = 2500) -> None:
    """Rows per Arrow batch for whole texts, unless the session has its own setting: a batch of long texts is
    held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the one all executors share, ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster has to set it.  The folder goes
    when the application ends, or with :func:`clean`.
    """
    sc = spark.sparkContext
    if getattr(sc, "_meridia_dir", None) is None:
        kept = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not kept and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = kept.rstrip("/") if kept else "file://" + tempfile.mkdtemp(prefix="meridia-")
        sc._meridia_dir = f"{base}/meridia-{sc.applicationId}"
        atexit.register(_at_exit, spark)
    return sc._meridia_dir


def clean(spark: SparkSession) -> None:
    """Delete the tables that operators wrote on their way; results not yet read or saved go with them."""
    sc = spark.sparkContext
    folder, sc._meridia_dir = getattr(sc, "_meridia_dir", None), None
    if folder is not None and sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # noqa: BLE001  the JVM has gone first
        pass


#: Shuffle files go when the execution that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.  What was written needs its
    shuffles no more, so their files are deleted at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within ``limit``; else leave Catalyst to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) with comp the smallest id reachable, for every id in ``edges``.

    Each round every node adopts the least label around it, hooks its label's node to that label too, so whole
    trees merge, and then takes its label's label, so paths halve.  Labels only fall, and rounds go on until none
    changes: then all neighbours agree.  Labels stay in Spark; each round is written to the shared folder.  Labels are
    broadcast while they are few, so the many edges of one hub stay where they are; else they join by shuffle, whose
    large partitions adaptive execution splits.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    changed = True
    while changed:
        seen = both.join(small(labels.select(F.col("id").alias("b"), F.col("comp").alias("near"))), "b")
        best = seen.groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = labels.join(small(best), "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        step = materialize(step)
        hooks = step.groupBy(F.col("was").alias("id")).agg(F.min("next").alias("hook"))
        hooked = materialize(step.join(small(hooks), "id", "left").select("id", F.least("next", "hook").alias("next"), "was"))
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("over"))
        new = materialize(
            hooked.join(small(jump), "next", "left").select("id", F.least(F.col("next"), F.coalesce("over", "next")).alias("comp"), "was")
        )
        labels = new.select("id", "comp")
        changed = new.where("comp <> was").limit(1).count() > 0
    return labels
