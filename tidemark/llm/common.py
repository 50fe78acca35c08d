"""Helpers shared by the training-data operators: tables, the shared folder, learning folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, which all executors and the driver share.

    Where the setting is absent only a local master may go on: it then uses a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/tidemark-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_made: list[str] = []  # folders of ``written`` frames inside ``scratch``
_open = 0


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if _open:
        _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: set[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders of ``written`` frames that no later plan reads."""
    _delete(spark, {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})


class scratch:
    """Within it every frame that ``written`` makes is noted; at its end all but the kept ones are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> "scratch":
        global _open
        _open, self.first = _open + 1, len(_made)
        return self

    def keep_last(self) -> None:
        self.kept.add(_made[-1])

    def __exit__(self, *_: object) -> None:
        global _open
        _open -= 1
        _delete(self.spark, set(_made[self.first :]) - self.kept)
        del _made[self.first :]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, n_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts at a time."""
    for batch in batches:
        step = max(1, min(rows, int(n_bytes * batch.num_rows / max(batch.nbytes, 1))))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks_for(spark: SparkSession, n_bytes: int, a_task: int = 32 << 20) -> int:
    """A number of partitions that grows with the bytes to be read, and is at least that of the cores."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // a_task))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))
