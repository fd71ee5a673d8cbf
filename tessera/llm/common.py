"""Helpers shared by the corpus operators: shared scratch tables and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
PART_ROWS = 2_048


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session names it; only where that is unset
    and the master is local a private temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the unfinished tasks only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def append(df: DataFrame, to: DataFrame) -> DataFrame:
    """Write the rows of df to a scratch table and read the whole of it; df may come from the table."""
    df.write.mode("append").parquet(to._scratch)
    out = to.sparkSession.read.schema(to.schema).parquet(to._scratch)
    out._scratch = to._scratch
    return out


def drop(*tables: DataFrame) -> None:
    """Remove scratch tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def free(df: DataFrame) -> None:
    """Let the driver collect the plans of finished steps, so that their shuffle files go from the executors' disks."""
    df.sparkSession._jvm.java.lang.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with one call of fn per record batch; fn returns a RecordBatch or a list of them."""

    def run(batches):
        for b in batches:
            out = fn(b)
            yield from out if isinstance(out, list) else [out]
            del b, out
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give memory that a finished task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def flat_string(col: pa.Array) -> pa.Array:
    """A string array of one chunk, starting at offset zero of its buffers; null becomes the empty text."""
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    return pa.concat_arrays([col.cast(pa.large_string())])


def parts(rows: pa.RecordBatch, text, size: int = PART_ROWS):
    """(rows, texts as flat_string) of a batch in parts, so that a batch is never copied whole."""
    for k in range(0, rows.num_rows, size):
        some = rows.slice(k, size)
        yield some, flat_string(some.column(text))
