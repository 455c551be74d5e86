"""Tables that cut lineage, in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a stored table that one task reads (``gathered``).
PART = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set a local one is made, on a single machine only."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lingloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from reliable storage from now on; lost executors don't lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """``stored``, but read by a task for each PART bytes and not for each partition that it was made in.

    For steps that take few rows through many shuffles: a shuffle's tasks follow its setting, and each task that reads one of
    them and writes the next leaves files and events, however few its rows are. Never one part, which a join or an
    aggregate would take for a reason not to deal its rows out.
    """
    out = stored(df)
    made = out._jdf.queryExecution().logical().rdd()
    path = out.sparkSession._jvm.org.apache.hadoop.fs.Path(made.getCheckpointFile().get())
    size = path.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(2, -(-size // PART))
    return out.coalesce(parts) if parts < made.getNumPartitions() else out


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder; its size is known, so a small one may be broadcast."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
