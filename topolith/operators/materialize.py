"""Cutting lineage through tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that setting is absent, the context's checkpoint folder is used.
    Where that is absent too, a local session (one machine, as in tests) gets a
    temporary folder that goes when Python ends; elsewhere it is an error, as a
    folder of one machine can't be read by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="topolith-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_open: list[list[Stored]] = []


class Stored:
    """A DataFrame written once to the shared folder and read back."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_dir(spark)}/topolith/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)
        if _open:
            _open[-1].append(self)

    def keep(self) -> Stored:
        """Outlives the ``scratch`` block that it was made in."""
        if _open and self in _open[-1]:
            _open[-1].remove(self)
        return self

    def drop(self) -> None:
        """Deletes the files; frames that read them can't be used afterwards."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored within the block are deleted at its end, but for those that ``keep`` was called on.

    For callers that have written an operator's result: the tables that it read
    on the way are then of no use.
    """
    _open.append([])
    try:
        yield
    finally:
        for held in _open.pop():
            held.drop()


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it reread, lineage cut.

    Lost executors cost nothing: the files are in storage that all executors
    share. They stay as long as results that read them may be needed: to the
    end of the ``scratch`` block around, if there is one.
    """
    return Stored(df).df
