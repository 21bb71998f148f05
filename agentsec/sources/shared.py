"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written to the folder that the session names in spark.checkpoint.dir, and read from there.

    A session without one gets a temporary folder where all of Spark is one process; elsewhere it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="agentsec-")
        context.setCheckpointDir(path)
    return df.checkpoint()
