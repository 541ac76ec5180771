"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local (tests) a temporary folder
    is made and set; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestar-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage. Within a `scope`
    what is written is removed at its end, unless it is kept."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    note(df.sparkSession, *_files(out))
    return out


def note(spark: SparkSession, *paths: str) -> None:
    """Tell the innermost scope of this thread about files it may remove."""
    if stack := getattr(_scopes, "stack", None):
        stack[-1].made.update(_whole_name(spark, p) for p in paths)


def _whole_name(spark: SparkSession, name: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _files(df: DataFrame) -> set[str]:
    """The checkpoints and tables that a frame reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRDD" and leaf.rdd().getCheckpointFile().isDefined():
            found.append(leaf.rdd().getCheckpointFile().get())
        elif kind == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(j).toString() for j in range(roots.size())]
    return {_whole_name(df.sparkSession, x) for x in found}


class Scope:
    """What was written while it was open."""

    def __init__(self) -> None:
        self.made: set[str] = set()
        self.kept: set[str] = set()

    def keep(self, *frames: DataFrame | None) -> None:
        """Leave what these frames read; an outer scope becomes responsible."""
        for frame in frames:
            if frame is not None:
                self.kept |= _files(frame)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Intermediate tables of a large operation, removed from the shared folder
    at its end. Frames that outlive it are named by `keep`; an error removes all."""
    stack = _scopes.__dict__.setdefault("stack", [])
    own = Scope()
    stack.append(own)
    try:
        yield own
    except BaseException:
        own.kept = set()
        raise
    finally:
        stack.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path
        for name in sorted(own.made - own.kept):
            where = path(name)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        note(spark, *(own.made & own.kept))


_scopes = threading.local()


def clustered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The frame as a Parquet table in the shared folder, in order of `keys`, so
    that a filter on them reads only the row groups it needs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys).sortWithinPartitions(*keys, *order).write.parquet(path)
    note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by
    PYTHONPATH or the working folder; once for each application."""
    home = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    app = spark.sparkContext.applicationId
    if home in known or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((home / "lodestar").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


_shipped: set[str] = set()
