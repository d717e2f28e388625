"""What operators need from the session: a shared folder to cut lineage in, and this package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from pathlib import Path
from typing import ParamSpec, TypeVar

from pyspark.sql import DataFrame, SparkSession

P = ParamSpec("P")
R = TypeVar("R")

ROOT = str(Path(__file__).resolve().parent.parent)
#: Python workers give large freed blocks back, instead of keeping them from one stage to the next. Users' settings win.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Python workers import this package by name; add its folder to the path they start with."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, os.environ.get(name, value))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to as many partitions as a shuffle has, which nothing merges again: rows of few bytes and much work lie in few files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


class Cut(str):
    """Path of a written table."""


#: Paths of the tables cut since each running owner began, the innermost owner last.
OWNED: ContextVar[tuple[list[Cut], ...]] = ContextVar("owned", default=())


def cut(df: DataFrame, name: str) -> tuple[DataFrame, Cut]:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages no longer depend on any
    executor's local files. Returns the table and its path, for :func:`discard`."""
    spark = df.sparkSession
    path = Cut(f"{shared_dir(spark)}/fieldloom-{name}-{uuid.uuid4().hex}")
    for own in OWNED.get()[-1:]:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut` wrote and that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tables_read(df: DataFrame) -> str | None:
    """Root folders of the files that ``df`` reads, one a line; None if its plan has a relation that doesn't tell."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots.append(leaf.relation().location().rootPaths().mkString("\n"))
        elif kind not in ("LocalRelation", "LogicalRDD", "OneRowRelation", "OneRowRelation$", "Range"):
            return None
    return "\n".join(roots)


def owning(operator: Callable[P, R]) -> Callable[P, R]:
    """Decorator of an operator that returns a DataFrame or several: of the tables that it cuts, those that its result
    doesn't read are deleted when it returns, all of them when it fails. The others go to the owner that called it,
    if one did, and else stay for as long as the result may be read."""

    @wraps(operator)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        own: list[Cut] = []
        before = OWNED.set((*OWNED.get(), own))
        try:
            result = operator(*args, **kwargs)
            tables = [t for t in (result if isinstance(result, tuple) else (result,)) if isinstance(t, DataFrame)]
            read = [tables_read(t) for t in tables]
        except BaseException:
            spark = SparkSession.getActiveSession()
            for path in own if spark else []:
                discard(spark, path)
            raise
        finally:
            OWNED.reset(before)
        for path in own:
            if tables and all(r is not None and path.rsplit("/", 1)[1] not in r for r in read):
                discard(tables[0].sparkSession, path)
            else:
                for outer in OWNED.get()[-1:]:
                    outer.append(path)
        return result

    return run
