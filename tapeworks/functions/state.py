"""Cutting lineage through storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark setting under which the shuffle files of an action go when the action ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark setting and most rows that travel to Python at once: ten times Spark's own number of rows with long texts
#: fill hundreds of megabytes in each worker.
BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own; on
    a cluster, whose executors could not read such a folder, its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back from there.

    Once the rows are written, the shuffle files that led to them are of no more use. They are
    freed at once instead of at the driver's next garbage collection. Rows go to Python in
    batches of at most ``MOST_ROWS``.
    """
    spark = df.sparkSession
    shared_folder(spark)
    rows = int(spark.conf.get(BATCH_ROWS))
    wanted = {FREE_SHUFFLES: "true", BATCH_ROWS: str(min(rows, MOST_ROWS) if rows > 0 else MOST_ROWS)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint(eager=True)  # the settings hold for frames made under them
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
