"""Shared helpers: reading tables, bounded Arrow batches, shared intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def utf8(column: str) -> F.Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def apart(name: str, taken: list[str]) -> str:
    """The name under which a column of the input comes out beside an operator's own columns ``taken``."""
    return f"kept_{name}" if name.lower() in (t.lower() for t in taken) else name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and all runs in one process (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/tickloom-intermediate"
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has gone; the cluster's own cleaning of that folder remains
        pass


#: The name of a stored table's folder.
OURS = re.compile(r"/tickloom-\w+-[0-9a-f]{12}$")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage is cut, and lost executors cost no more than the stage that reads it. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Removes the files of stored tables, once all that was made from them has been written."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if OURS.search(f):
                _remove(df.sparkSession, f)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are out of reach."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(rows: DataFrame, key: str, mix: str, block: int, bounded: bool = False) -> DataFrame:
    """Rows of keys that have two or more, with the pair of blocks (i, j) in which a task compares them.

    A key's rows lie in blocks of about ``block`` by ``mix``; each row goes to a task for every block of its key. ``side``: 0 for block i, 1 for block j. Keys of one block have the task (0, 0) alone. ``bounded``: the number of keys doesn't grow with the data, so that their sizes are broadcast; else sizes are stored, so that both sides of the join are plain exchanges, which Spark splits where a key is hot.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    placed = rows.join(F.broadcast(sizes) if bounded else stored(sizes, "sizes"), key).withColumn("_own", F.pmod(F.xxhash64(F.lit(5), mix), F.col("_blocks")).cast("int"))
    each = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_blocks", "_own", "_other")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows with equal numbers in the first ``keys`` columns, as tables."""
    current, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(b.num_rows - 1, bool)
        for a in at:
            new |= a[1:] != a[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(a[start]) for a in at)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)


def lots(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first ``keys`` columns (numbers), in tables of whole groups and ``least`` rows or more; with the row at which each group begins, and the end."""
    held: list[pa.Table] = []
    size = 0

    def cut(last: bool) -> tuple[np.ndarray, pa.Table, pa.Table]:
        t = pa.concat_tables(held).combine_chunks()
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in range(keys):
            a = t.column(c).to_numpy()
            new |= a[1:] != a[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
        end = t.num_rows if last else int(starts[-2])
        return starts if last else starts[:-1], t.slice(0, end), t.slice(end)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        size += b.num_rows
        if size >= least:
            starts, whole, rest = cut(False)
            held, size = [rest], 0
            if whole.num_rows:
                yield starts, whole
    if held:
        starts, whole, _ = cut(True)
        if whole.num_rows:
            yield starts, whole


def lean(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` over a partition's batches, after which what it has freed goes back to the system: Python workers live on, and the next stage's tasks need the room. ``forget``: called first, to empty memories that only this stage uses."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return lean_run
