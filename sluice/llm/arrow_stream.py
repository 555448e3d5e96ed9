"""Token ids as Arrow stream files of fixed-size lists.

Rows are sorted by id over range partitions.  Each task encodes its rows and writes
one Arrow IPC stream: record batches of ``rows`` fixed-size lists (``ids`` and a
validity ``mask`` of ``length`` each), uncompressed, so any sequence is a view into
the mapped file.  A second stream beside it lists the documents (id, start in the
file, count).  A manifest row names both, with the byte offset of every batch.
Files get fresh names, and only those of the attempts whose manifest rows arrived
count, so a lost executor leaves stray files but no wrong ones.  Places over all
files come from a running sum over the manifest, one row a task.

The folder must be one that pyarrow.fs can write from executors (file, hdfs, s3, gs).

Null texts count as empty (the end id alone).  Order is by id, nulls first, ties by
text; repeated rows each get a place.  Columns other than id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, ids_and_texts, slices, sql_type, staged, task, tokenizer_path
from sluice.llm.library_ids import library_ids


class StreamWriter:
    def __init__(self, sink, length: int, rows: int, dtype):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink, self.writer = sink, pa.ipc.new_stream(sink, self.schema)
        self.parts, self.n, self.total, self.offsets = [], 0, 0, []

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.n += len(ids)
        if self.n >= self.rows * self.length:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        step = self.rows * self.length
        whole = len(flat) if last else len(flat) // step * step
        for at in range(0, whole, step):
            ids = flat[at : min(at + step, whole)]
            real, pad = len(ids), -len(ids) % self.length
            ids = np.concatenate([ids, np.zeros(pad, self.dtype)]) if pad else ids
            self.offsets.append(self.sink.tell() or len(self.schema.serialize()))  # the schema goes out with the first batch
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.total += whole
        self.parts, self.n = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        self.flush(last=True)
        self.writer.close()


def read_sequence(buffer: pa.Buffer, schema: pa.Schema, offsets: list[int], rows: int, index: int) -> tuple[pa.Array, pa.Array]:
    """ids and mask of one sequence as views into the mapped file."""
    message = pa.ipc.read_message(pa.BufferReader(buffer.slice(offsets[index // rows])))
    batch = pa.ipc.read_record_batch(message, schema)
    return batch.column(0)[index % rows].values, batch.column(1)[index % rows].values


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_ids long, offsets array<long>"


def write_streams(df: DataFrame, path: str, folder: str, length: int = 2048, rows: int = 64, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; the manifest as a table, with first_id (ids in earlier files)."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        filesys, base = filesystem(folder)
        filesys.create_dir(base, recursive=True)
        encode, name = library_ids(path), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        dtype = np.uint16 if encode.t.get_vocab_size() <= 1 << 16 else np.uint32
        with filesys.open_output_stream(f"{base}/{name}.arrow") as sink, filesys.open_output_stream(f"{base}/{name}.docs.arrow") as docs_sink:
            out, docs, n_docs, at = StreamWriter(sink, length, rows, dtype), None, 0, 0
            for b in slices(batches, 1 << 20):
                ids = [np.append(x, np.uint32(end_id)).astype(dtype) for x in encode(b.column(1).to_pylist())]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                table = pa.RecordBatch.from_arrays([b.column(0), pa.array(at + np.cumsum(counts) - counts), pa.array(counts)], names=["id", "start", "n"])
                docs = docs or pa.ipc.new_stream(docs_sink, table.schema)
                docs.write_batch(table)
                out.add(np.concatenate(ids))
                n_docs, at = n_docs + len(ids), at + int(counts.sum())
            if docs:
                docs.close()
            out.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "ids_file": f"{name}.arrow", "docs_file": f"{name}.docs.arrow", "n_docs": n_docs, "n_ids": at, "offsets": out.offsets}], schema=pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("offsets", pa.list_(pa.int64()))]))

    dealt = ids_and_texts(df, id_col, text_col).repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = staged(dealt.mapInArrow(task(write, reuse=True), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task, no more
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start over all files, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    @task
    def read(batches):
        filesys, base = filesystem(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            with filesys.open_input_file(f"{base}/{row['ids_file']}") as f, filesys.open_input_stream(f"{base}/{row['docs_file']}") as g:
                blocks, have, held = iter(pa.ipc.open_stream(f)), 0, []
                for docs in pa.ipc.open_stream(g):
                    starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    need = int(counts.sum())
                    while have < need:
                        b = next(blocks)
                        ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten()
                        held.append(ids[: mask.true_count])
                        have += len(held[-1])
                    flat = np.concatenate(held)
                    data = memoryview(flat[:need].astype("<u4").tobytes())
                    cuts = np.concatenate([[0], np.cumsum(counts)]) * 4
                    crc = [zlib.crc32(data[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    held, have = [flat[need:]], have - need
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["first_id"]), pa.array(counts), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "ids_file", "docs_file", "first_id").repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(read, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def op9_arrow_stream(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "token-streams")
    manifest = write_streams(docs, tokenizer_path("byte_bpe_50k.json"), folder)
    return read_documents(manifest, folder, sql_type(docs, "doc_id"))
