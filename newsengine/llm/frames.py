"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

REPO = str(Path(__file__).resolve().parents[2])
#: Rows of an Arrow batch: whole texts may be long, and each batch is held at once on both sides.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Keep Arrow batches small, and let workers import this package when it is not installed.

    On a real cluster the package is shipped with ``--py-files``; the path
    covers workers that share the driver's file system.
    """
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS or int(spark.conf.get(BATCH_CONF)) <= 0:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def release() -> None:
    """Give freed memory back at a task's end: Python workers live on and share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary one only on a single machine where it is unset, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="newsengine-checkpoint-"))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has written, wherever Spark keeps it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder of compressed files in the shared checkpoint folder, each kept until it is dropped."""

    def __init__(self, spark: SparkSession):
        shared_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4()}"

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` written and read again, with its path."""
        path = f"{self.folder}/{uuid.uuid4()}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        """Delete what nothing reads any more."""
        for path in paths:
            drop_folder(self.spark, path)


def fresh(df: DataFrame, *names: str) -> str | tuple[str, ...]:
    """Column names based on ``names`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else tuple(out)


def map_columns(df: DataFrame, keep: list[str], inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., tuple]], rows: int = 512, lists: bool = True) -> DataFrame:
    """Add columns that a Python function computes from Arrow batches.

    ``make()`` runs once in each task and gives a function from one list (or,
    without ``lists``, Arrow array) per input column to one list or array per
    field. The result holds ``keep``
    without names that ``fields`` replaces, then ``fields``. Batches are cut
    to ``rows`` rows so that long texts do not pile up.
    """
    replaced = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in replaced]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    arrow = [to_arrow_type(f.dataType) for f in fields]
    source = df.select(*keep, *[df[c].alias(f"__in{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        n = len(keep)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                given = [part.column(n + i) for i in range(len(inputs))]
                made = work(*[x.to_pylist() for x in given] if lists else given)
                cols = [part.column(i) for i in range(n)]
                cols += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])
        del work
        release()

    prepare_workers(df.sparkSession)
    return source.mapInArrow(run, schema)
