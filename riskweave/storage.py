"""Where written intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written since the innermost ``dropping`` began.
_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> str:
    """The path that df is written to."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return at


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "table", stays: bool = False) -> DataFrame:
    """df written and read back: it is computed once, and lost executors cost no recomputation of it.

    Within ``dropping`` the table goes when the step ends, unless it ``stays``.
    """
    at = write(df, name)
    owned = _owned.get()
    if owned is not None and not stays:
        owned.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def dropping(spark: SparkSession):
    """A step whose result does not read the tables that it cuts: they are deleted when it has succeeded."""
    owned: list[str] = []
    before = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(before)
    delete(spark, owned)


def drops(step):
    """A step within ``dropping``; its first DataFrame or session argument names the session."""

    def run(*args, **kwargs):
        first = next(x for x in [*args, *kwargs.values()] if isinstance(x, DataFrame | SparkSession))
        with dropping(first if isinstance(first, SparkSession) else first.sparkSession):
            return step(*args, **kwargs)

    run.__doc__, run.__name__ = step.__doc__, step.__name__
    return run
