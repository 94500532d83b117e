"""Cutting lineage: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)  # tables staged inside ``settled``


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, a temporary one for a local session, in which all
    tasks run on this machine (tests), and one in the warehouse for a cluster."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not configured:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        configured = f"file://{tempfile.mkdtemp(prefix='lanternfish-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lanternfish-staging"
        spark.conf.set(CHECKPOINT_KEY, configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for a shuffle of ``size`` rows or bytes: the session's number, or more if one would get more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    if (passing := _PASSING.get()) is not None:
        passing.append(staged)
    return staged


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stage`` of what ``make`` returns.  Tables that ``make`` stages on its way are deleted once its result is written, as
    nothing reads them again, and also where it fails."""
    passed: list[DataFrame] = []
    token = _PASSING.set(passed)
    try:
        result = stage(make(), name)
        passed.pop()  # the result itself
    finally:
        _PASSING.reset(token)
        for table in passed:
            discard(table)
    if (passing := _PASSING.get()) is not None:
        passing.append(result)
    return result


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that no query will read again."""
    jvm = staged.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    path.getFileSystem(staged.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
