"""Tables between the steps of a plan, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    A temporary folder of this machine serves only a local master, as in tests. On any other each executor would
    write to its own disk, so a missing setting is an error there.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumenframe-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lumenframe-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear(spark: SparkSession) -> None:
    """Drop this application's tables, once no result that reads them is needed any more."""
    _delete(spark, _own(spark))


_steps: ContextVar[tuple[list[str], ...]] = ContextVar("steps", default=())


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Drops the tables saved inside when it ends, all but those to be kept, which belong to the step around it."""
    mine: list[str] = []
    before = _steps.set((*_steps.get(), mine))
    try:
        yield
    finally:
        _steps.reset(before)
        for path in mine:
            _delete(spark, path)


#: Rows to a file where a table's size is known beforehand.
ROWS = 50_000


def saved(df: DataFrame, name: str, rows: int | None = None, *, keep: bool = False) -> DataFrame:
    """Write and read back: lineage ends here, and a lost executor costs no step before it.

    ``rows`` is an upper bound of the table's rows: small tables then take few files and tasks. With ``keep`` the
    table belongs not to the innermost :func:`step` but to the one around it.
    """
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS) or 1)
    path = f"{_own(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    steps = _steps.get()[: -1 if keep else None]
    if steps:
        steps[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
