"""Where intermediate tables live, and how sizes are checked before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and driver and
    executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="quizmill-")
    return _fallback[app]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quizmill-{spark.sparkContext.applicationId}"


_groups: list[str] = []


@contextmanager
def group(name: str) -> Iterator[None]:
    """Intermediate tables made inside go to a folder of their own, which ``forget_intermediates`` can
    delete apart from the others."""
    _groups.append(f"/{name}")
    try:
        yield
    finally:
        _groups.pop()


def group_path(spark: SparkSession, name: str = "") -> str:
    return _own_dir(spark) + (f"/{name}" if name else "")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}{''.join(_groups)}/{name}-{uuid.uuid4().hex[:12]}"


def forget_intermediates(spark: SparkSession, name: str = "") -> None:
    """Delete the intermediate tables of this application, or of one ``group``; call it when the results
    made from them are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(group_path(spark, name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; what is needed later is written to a path
    that was made outside."""
    with group(f"{name}-{uuid.uuid4().hex[:12]}"):
        inside = "".join(_groups)[1:]
        yield
    forget_intermediates(spark, inside)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside remove their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: short lineage, safe when executors are lost."""
    path = path or new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).agg(F.count(F.lit(1))).first()[0] <= max_rows
