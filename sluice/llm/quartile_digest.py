"""Document fingerprints: quartile bucket digests.

Six byte triplets of each five-byte window are hashed into 256 buckets.  A digest has
the length on a logarithmic scale, two ratios of the bucket counts' quartiles, and two
bits for each bucket: which quartile its count falls in.  The difference of two digests
adds up bucket, length and ratio differences and is bounded by ``BOUND``; likeness is
1 - difference / BOUND.

Next documents come from range partitions in id order: inside a partition the next row
is at hand, and only first and last rows of partitions meet in a small join.

Null texts count as empty.  Texts of under five bytes are filled with zero bytes.  Order
is by id (nulls first), ties by text; a table of one row is its own next.  Columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import ids_and_texts, slices, sql_type, staged, task

BUCKETS, BOUND = 256, 400
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))


def bucket_counts(texts: list[bytes], piece: int = 1 << 20) -> np.ndarray:
    """(texts, BUCKETS); long texts are counted in pieces that overlap by the window less one."""
    if any(len(t) > piece + 4 for t in texts):
        counts = np.zeros((len(texts), BUCKETS), np.int64)
        for own, t in zip(counts, texts, strict=True):
            for at in range(0, max(len(t) - 4, 1), piece):
                own += bucket_counts([t[at : at + piece + 4]], piece)[0]
        return counts
    texts = [t if len(t) >= 5 else t.ljust(5, b"\0") for t in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    last = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= 4  # a window ends here
    base = (doc[last] * BUCKETS).astype(np.int64)
    at = np.flatnonzero(last)
    byte = [raw[at - k] for k in range(5)]
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for salt, (i, j, k) in enumerate(TRIPLETS):
        h = (byte[i] | byte[j] << np.uint32(8) | byte[k] << np.uint32(16) | np.uint32((salt + 1) << 24)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        counts += np.bincount(base + (h >> np.uint32(24)), minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """uint8 (texts, 67): length code, two ratio codes, 64 bytes of bucket quartiles."""
    if not texts:
        return np.zeros((0, 3 + BUCKETS // 4), np.uint8)
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1 : BUCKETS * k // 4] for k in (1, 2, 3))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, BUCKETS // 4, 4)
    body = code[..., 0] << 6 | code[..., 1] << 4 | code[..., 2] << 2 | code[..., 3]
    length = np.minimum(np.floor(np.log(np.maximum([len(t) for t in texts], 1)) / np.log(1.1)), 255)[:, None]
    ratios = [q * 63 // np.maximum(q3, 1) for q in (q1, q2)]
    return np.concatenate([length.astype(np.uint8), *(r.astype(np.uint8) for r in ratios), body.astype(np.uint8)], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to BOUND."""
    x, y = (np.stack([d[:, 3:] >> s & 3 for s in (6, 4, 2, 0)]).astype(np.int16) for d in (a, b))
    body = np.abs(x - y)
    body = (body + 3 * (body == 3)).sum(axis=(0, 2))
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3].astype(np.int64)).sum(axis=1)
    return np.minimum(body + head, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / BOUND


def compare(a: str, b: str) -> float:
    """Likeness of two digests in hex."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8)[None] for s in (a, b))
    return float(likeness(x, y)[0])


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex)."""

    @task
    def run(batches):
        for b in slices(batches, 2 << 20):
            d = digests([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes().hex() for x in d], pa.string())], names=["id", "fingerprint"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"id {sql_type(df, id_col)}, fingerprint string")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(texts: list[str], following: list[str], own: np.ndarray, nxt: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, n).encode("utf-8", "surrogatepass") for t, n in zip(texts, following, strict=True)]
    other = digests(changed)
    cols = [[len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in other], likeness(own, other), likeness(own, nxt)]
    return [pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)]


def edited_likeness(df: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark, kind = df.sparkSession, sql_type(df, id_col)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @task
    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def rows(role, ids, texts, results):
            results = results or [pa.nulls(len(ids), k) for k in KINDS]
            return pa.RecordBatch.from_arrays([pa.array([role] * len(ids), pa.int32()), pa.array([part] * len(ids), pa.int32()), ids, pa.array(texts, pa.string()), *results], names=["role", "part", "id", "text", *NAMES])

        for b in slices(batches, 2 << 20):
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            own = digests([t.encode("utf-8", "surrogatepass") for t in texts])
            if held is None:
                yield rows(1, ids.slice(0, 1), texts[:1], None)
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, own = held[1] + texts, np.concatenate([held[2], own])
            held = ids.slice(len(ids) - 1), texts[-1:], own[-1:]
            if len(texts) > 1:
                yield rows(0, ids.slice(0, len(ids) - 1), [None] * (len(texts) - 1), against_next(texts[:-1], texts[1:], own[:-1], own[1:]))
        if held:
            yield rows(2, held[0], held[1], None)

    @task
    def meet(batches):
        for b in slices(batches, 2 << 20):
            texts, following = ([t or "" for t in b.column(k).to_pylist()] for k in (1, 2))
            own, nxt = (digests([t.encode("utf-8", "surrogatepass") for t in x]) for x in (texts, following))
            yield pa.RecordBatch.from_arrays([b.column(0), *against_next(texts, following, own, nxt)], names=["id", *NAMES])

    order = F.col("id").asc_nulls_first()
    dealt = ids_and_texts(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange(parts, order).sortWithinPartitions(order, "text")
    done = staged(dealt.mapInArrow(run, f"role int, part int, id {kind}, text string, {SQL}"), "digests")
    ends = done.filter("role = 1").select("part")  # a row for each partition
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    following = ends.select("part", following.alias("next_part"))
    firsts = done.filter("role = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = done.filter("role = 2").select("part", "id", "text").join(following, "part").join(firsts, "next_part").select("id", "text", "next_text")
    return done.filter("role = 0").select("id", *NAMES).unionByName(pairs.mapInArrow(meet, f"id {kind}, {SQL}"))


def op5_quartile_digest(spark, sf_dir):
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
