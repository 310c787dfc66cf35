"""Intermediate tables in the folder that driver and executors share.

They cut the lineage of iterative plans and survive lost executors; whoever makes one
drops it when nothing reads it any more.  A result may read such a table: release deletes it
when the caller is done, and what is left goes when the process ends.  An operator
that fails deletes what it wrote (guarded).
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Hadoop path and configuration of each table that materialize wrote and nothing deleted yet.
_live: dict[str, tuple] = {}
#: Paths written by the guarded operator that is being run.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="vendora-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder, which release and the end of the process delete."""
    path = f"{shared_folder(spark)}/vendora-{uuid.uuid4().hex}{suffix}"
    _live[path] = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    if (written := _written.get()) is not None:
        written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vendora_path = path
    return out


def _delete(path: str) -> None:
    if path in _live:
        place, conf = _live.pop(path)
        place.getFileSystem(conf).delete(place, True)


def _delete_all() -> None:
    for path in list(_live):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


atexit.register(_delete_all)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote, once nothing will read it again."""
    if path := getattr(df, "_vendora_path", None):
        _delete(path)


def release(df: DataFrame) -> None:
    """Delete the tables of this process that a result reads, once the caller has used it; df can't be read afterwards."""
    found = {m[0].rpartition("/")[2] for f in df.inputFiles() if (m := re.match(r".*/vendora-[0-9a-f]{32}[^/]*(?=/)", f))}
    for path in [p for p in _live if p.rpartition("/")[2] in found]:
        _delete(path)


def live() -> set[str]:
    return set(_live)


def guarded(fn):
    """An operator that deletes the tables which it wrote, if it fails."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        written: list[str] = []
        outer, token = _written.get(), _written.set(written)
        try:
            return fn(*args, **kwargs)
        except BaseException:
            for path in written:
                _delete(path)
            raise
        finally:
            _written.reset(token)
            if outer is not None:
                outer += written

    return run


class Tables:
    """Intermediate tables of one run of an operator, all dropped together."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def own(self, df: DataFrame) -> DataFrame:
        """A table that materialize wrote, to be dropped by close."""
        self.made.append(df)
        return df

    def write(self, df: DataFrame) -> DataFrame:
        return self.own(materialize(df))

    def drop(self) -> None:
        """Delete the tables."""
        for df in self.made:
            discard(df)
        self.made.clear()

    def close(self, result: DataFrame) -> DataFrame:
        """result written by itself, so that nothing reads the tables any more, and the tables dropped, also if that fails."""
        try:
            return materialize(result)
        finally:
            self.drop()
