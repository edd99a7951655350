"""What the corpus operators share: written intermediate tables and Arrow maps.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it, so a lost executor costs
a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of bytes other than space, tab and the four line controls; bytes.split() gives the same words.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Whether a query's shuffle files are removed at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one long that are sent to the tasks of a join with texts at most; about 30 MB with their hash table.
SENT = 1 << 19

_PACKAGE = Path(__file__).resolve().parents[1]
#: Paths of intermediate tables that are still there.
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends, or by `forget`."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    _paths.append(path)
    return path


def held() -> int:
    """How many intermediate tables there are; a mark for `forget`."""
    return len(_paths)


def forget(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Removes the intermediate tables made since a mark, once all that reads them is written; the files of those kept stay."""
    files = [f for k in keep for f in k.inputFiles()[:1]]
    for path in _paths[mark:]:
        if not any(path.split("/plumbline/")[-1] in f for f in files):
            fs, at = _at(spark, path)
            fs.delete(at, True)
            _paths.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, its lineage cut, its shuffle files gone.

    Without the setting these stay until the driver happens to collect its garbage, so the disk that a chain of tables takes
    would be the sum of its shuffles.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def with_few(rows: DataFrame) -> DataFrame:
    """A written table of one narrow column, to be sent to the tasks of a join if it has SENT rows at most.

    The join's other side, whole texts, isn't shuffled then. A larger table is joined as Spark plans it.
    """
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline", None) is None:
        path = Path(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
        sc._plumbline = str(path)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f, schema), with this package on the Python workers' path.

    A worker lives on between tasks and operators; at the end of a task it gives back what the task has freed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    _ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(texts: pa.Array, budget: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about budget bytes of text each, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (n or 0) > budget:
            yield slice(start, i)
            start, held = i, 0
        held += n or 0
    if start < len(texts):
        yield slice(start, len(texts))


def n_words(text: str = "text"):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
