"""Session helpers: where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (tests) may fall
    back to a folder on this machine; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vicinity-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and carries real sizes, so
    Spark decides by itself whether a later join can broadcast it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, marked as a table that grows with the data: the next join on it shuffles both sides.

    Spark takes the size of files for the size of rows. Names and lots pack to a fiftieth, and taking a name apart makes
    many rows of one, so it would send such a table through the driver.
    """
    return df.hint("merge")


_WRITTEN: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: built and written by the first one of the application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        path = f"{scratch_dir(spark)}/once-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
