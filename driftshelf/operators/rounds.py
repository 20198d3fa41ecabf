"""Jobs that go on until nothing changes: cutting the lineage of each round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there.

    The folder is `spark.checkpoint.dir`; only where that is unset and all tasks run in this
    process, as in tests, it is a temporary one.

    A checkpoint keeps the planner's estimate of its size, which a join multiplies: an integer of twice
    as many bits each round, some 100 MB after 25. So the rows are read as a table of unknown size.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="rounds-")
        context.setCheckpointDir(folder)
    session, kept = df.sparkSession, df.checkpoint()._jdf
    plain = session._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    return DataFrame(plain, session)
