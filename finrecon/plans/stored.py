"""Tables that several steps of a query read, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and stored in the folder that spark.checkpoint.dir names; on one machine, as in tests, in one of our own if the session names none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
