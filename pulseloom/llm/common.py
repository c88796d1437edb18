"""Shared plumbing of the training-data operators.

Working tables live in the folder that the session names in ``spark.checkpoint.dir`` (shared by the
driver and every executor); a private temporary folder is set only where the session names none and all runs in one process.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401  a worker knows pa.compute only then
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z on bytes, everything else untouched.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same for str.translate.
LOWER_STR = {c: c + 32 for c in range(65, 91)}
#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER_AZ.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for working tables."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            named = found.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            named = tempfile.mkdtemp(prefix="pulseloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            sc.setCheckpointDir(named)
    return named.rstrip("/")


_folders: set[str] = set()
_tables: list[str] = []


def table_mark() -> int:
    """A mark for ``drop_tables``: how many working tables there have been."""
    return len(_tables)


def drop_tables(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete the working tables written since ``mark`` but those that ``keep`` reads. What else was made of them can't be read any more."""
    held = keep.inputFiles() if keep is not None else []
    for path in _tables[mark:]:
        if not any(path.rsplit("/", 1)[1] in file for file in held):
            _forget(spark, path)


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete an application's working tables when its driver ends in good order."""
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a working table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The tables of an application lie in one folder, which goes when the driver ends.
    """
    folder = f"{work_dir(df.sparkSession)}/pulseloom-{df.sparkSession.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, df.sparkSession, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it (in either case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(lengths, most: int):
    """Cut consecutive rows into (start, end) runs of at most ``most`` bytes, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def tidy(run):
    """A function over Arrow batches whose worker gives its memory back when the task ends: workers live on, and what
    earlier stages left in them (caches in reference cycles, freed but unreturned blocks) would add up over a session."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def release(spark: SparkSession) -> None:
    """Collect the garbage of all JVMs before a large stage: their heaps grow over a session and are only given back then."""
    spark._jvm.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Rows of text that go to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: bound the Arrow batches, which the JVM and each worker hold several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
