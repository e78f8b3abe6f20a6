"""Cutting lineage so that a job survives lost executors, and connected components on top of it."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, as in tests on one
    machine, one of our own; a cluster must name one, since its machines share no local folder."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lithos-")
    return at


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into ``shared_folder``."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    # a checkpoint would carry on the constraints of the plan it cuts, which multiply in a loop
    name = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, was)


def sweep(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark's cleaner deletes the shuffle and checkpoint files of
    steps that are over, and the classes generated for them are unloaded."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that one task of the component search takes before another is worth its files.
TASK_ROWS = 200_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for each node of edges (a, b): comp is the smallest id it can reach.

    Each round lowers every label to the least label among the neighbours of the nodes under it and then
    lets labels jump to their own labels, so paths shrink by a factor per round. Minima are
    combined on the map side, so a node with very many edges costs its partition one row per task;
    the joins on it are of the kind that Spark splits. The number of tasks follows the edges.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut(
        edges.select("a", "b")
        .where("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .groupBy("a", "b")
        .agg(F.lit(1).alias("x"))
        .drop("x")
    )
    tasks = max(1, min(width, -(-both.count() // TASK_ROWS)))
    both = both.coalesce(tasks)
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    label = cut(label.coalesce(tasks))
    for _ in range(rounds):
        near = (
            both.join(label.select(F.col("id").alias("b"), "comp"), "b")
            .coalesce(tasks)
            .groupBy("a")
            .agg(F.min("comp").alias("m"))
            .select(F.col("a").alias("id"), "m")
        )
        step = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp")).coalesce(tasks)
        # hook: a label itself follows the best label that any node under it saw; then jump
        hook = step.groupBy("was").agg(F.min("comp").alias("best")).select(F.col("was").alias("comp0"), "best")
        step = step.join(hook, step.was == hook.comp0).select("id", "was", F.least("comp", "best").alias("comp")).coalesce(tasks)
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = cut(step.join(up, "comp").select("id", F.least("up", "comp").alias("comp"), "was").coalesce(tasks))
        moved = new.where("comp <> was").limit(1).count()
        label = new.select("id", "comp")
        del near, step, hook, up, new
        sweep(edges.sparkSession)
        if not moved:
            return label
    raise RuntimeError("components did not settle")
