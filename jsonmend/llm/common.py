"""Shared helpers: table reading, lineage cuts in the shared folder, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators and deletable characters of the text contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder is set only where none is named and everything runs in one
    process, as in tests; on a cluster that names none this raises RuntimeError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/jsonmend"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage so that a lost executor costs a re-read, never a
    recomputation, and fixes generated identifiers to one committed attempt.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_bucket(name: str, modulus: int) -> Column:
    """crc32 of a number's decimal text, modulo ``modulus``: the held-out rule."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


#: Rows in an Arrow batch; Spark's default of 10,000 whole documents is tens of MB on either side.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, unless the session already asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give unused memory back once a task's last batch is done; Python workers live on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def text_slices(texts, budget: int = 4_000_000):
    """Cut a list of texts into (start, end) runs of about ``budget`` characters."""
    start, used = 0, 0
    for k, t in enumerate(texts):
        if used and used + len(t) > budget:
            yield start, k
            start, used = k, 0
        used += len(t)
    if start < len(texts):
        yield start, len(texts)
