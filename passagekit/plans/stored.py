"""Rows that several jobs read, written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. A session on one machine without
    one, as in tests, gets a folder of its own; on a cluster that raises ``ValueError``, since a
    folder of one machine is not seen by the others.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="passagekit-checkpoints-"))
    return df.checkpoint()
