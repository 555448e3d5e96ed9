"""Byte-level BPE encoding and decoding.

Encoding runs the lazily determinised transducer of bpe_fst with ids on its
transitions: a token goes out as soon as no continuation can change it.  Decoding
streams: each id's bytes go through an incremental UTF-8 state machine that holds at
most three bytes of an unfinished character; ids whose bytes are whole characters
need no steps.

Null texts count as empty.  Repeated rows and ids come back as often as they went
in; columns other than id and text are not read; an empty table gives an empty one.
Very long texts are encoded and decoded piece by piece (cut where no pre-token can lie
across), between which the bound on transitions holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import bpe_fst
from sluice.llm.common import ids_and_texts, model, pieces, slices, sql_type, tokenizer_path


class Utf8Machine:
    """feed(bytes) gives the characters finished so far; close() what is left, as U+FFFD if unfinished."""

    def __init__(self):
        self.held = b""
        self.missing, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.held += bytes((b,))
                    self.missing -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(self.held.decode("utf-8"))
                        self.held = b""
                    continue
                out.append("�")
                self.reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held = bytes((b,))
                self.missing = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def reset(self) -> None:
        self.held, self.missing, self.low, self.high = b"", 0, 0x80, 0xBF

    def close(self) -> str:
        left = "�" if self.missing else ""
        self.reset()
        return left


class Codec:
    def __init__(self, path: str):
        self.vocabulary = bpe_fst.from_ranks(path)
        self.machine = bpe_fst.Machine(self.vocabulary, bpe_fst.kinds_by_pattern(), tuple)
        size = max(self.vocabulary.bytes_of) + 1
        tokens = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.whole = np.array([self.is_text(t) for t in tokens])
        self.tokens = tokens

    @staticmethod
    def is_text(token: bytes) -> bool:
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.array(bpe_fst.encode(self.machine, p) if p else [], "<u4") for p in pieces(text or "")])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.pool[at].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of a stream of ids: runs of whole-character ids at once, the others through the state machine."""
        machine, out, done = Utf8Machine(), [], 0
        for i in np.flatnonzero(~self.whole[ids]):
            if i > done:
                out.append(machine.close() if machine.missing else "")
                out.append(self.decode_bytes(ids[done:i]).decode("utf-8"))
            out.append(machine.feed(self.tokens[ids[i]]))
            done = i + 1
        if done < len(ids):
            out.append(machine.close())
            out.append(self.decode_bytes(ids[done:]).decode("utf-8"))
        out.append(machine.close())
        return "".join(out)


@model
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>)."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1 << 20):
            ids = [c.encode(t).astype(np.int32) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {sql_type(df, id_col)}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded string) from array<int> ids; bytes that aren't UTF-8 become U+FFFD; null ids: empty."""

    def run(batches):
        c = codec(path)
        for b in slices(batches, 1 << 20):
            out = [c.decode_text(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "decoded"])

    chosen = df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`").cast("array<int>"))
    return chosen.mapInArrow(run, f"`{id_col}` {sql_type(df, id_col)}, decoded string")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                n, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
                for p in pieces(t or ""):  # whole characters, so each piece decodes by itself
                    ids = c.encode(p)
                    n += len(ids)
                    ids_sum.update(ids.tobytes())
                    text_sum.update(c.decode_text(ids.astype(np.int64)).encode("utf-8"))
                rows.append((n, ids_sum.hexdigest(), text_sum.hexdigest()))
            n, a, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {sql_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_codec(spark, sf_dir):
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.tiktoken"))
