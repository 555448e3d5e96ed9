"""What the operators share: shared storage, column checks, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset and Spark runs in one process, a folder of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sluice-shared"
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    path = df.inputFiles()
    if path:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications, not called by operators: texts can be long, so Arrow batches of at most that many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


CUT = re.compile(r"\S(?=[ \n])")
MODELS: list = []


def model(make):
    """A worker keeps what ``make`` made, for later tasks, until drop_models()."""
    kept = lru_cache(maxsize=4)(make)
    MODELS.append(kept)
    return kept


def drop_models() -> None:
    """An operator with large working arrays asks for the memory that others' models hold."""
    for kept in MODELS:
        kept.cache_clear()


def tidy() -> None:
    """Give freed memory back: workers live on and hold what their allocators keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def task(run, reuse: bool = False):
    """``run`` for mapInArrow, with others' models dropped first; at the end its own and its buffers go, so that idle workers hold nothing.

    reuse: models stay for the worker's next task (speed against memory).
    """

    def alone(batches):
        if not reuse:
            drop_models()
        try:
            yield from run(batches)
        finally:
            if not reuse:
                drop_models()
            tidy()

    return alone


def grouped(run):
    """The same for applyInArrow: memory is given back after each group."""

    def alone(key, table):
        try:
            return run(key, table)
        finally:
            drop_models()
            tidy()

    return alone


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, as ``id`` and ``text``; null texts stay null.  Other columns, whatever their names, go."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes, so that one batch's working arrays stay small."""
    for b in batches:
        rows = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pieces(text: str, size: int = 1 << 17) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, each cut before a blank or line feed that follows another character than these.

    Byte-level BPE never has a pre-token across such a place, so pieces' tokens in a row are
    the text's.  A run without such a place stays one piece.
    """
    at = 0
    while len(text) - at > size:
        cut = next((m.start() + 1 for m in CUT.finditer(text, at + size - 1)), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def sql_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def utf8(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
