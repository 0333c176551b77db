"""Cutting plans: checkpoints in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder of spark.checkpoint.dir. Where that is unset: in the context's folder, or in a local one if
    the driver is the only machine, as in tests; on a cluster it raises."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            d = os.path.join(tempfile.gettempdir(), "placelark-checkpoints")
        spark.sparkContext.setCheckpointDir(d)
    return df.checkpoint()
