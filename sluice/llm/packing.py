"""Packing documents into sequences: minimum bin slack over remaining lengths.

Each task packs the rows it reads, in one pass and without a shuffle.  A document's
ids (with the end id) are cut into full sequences; what is left is a remaining
length.  When ``window`` remainders are held, sequences are filled: the longest
remainder opens one, and a bitset subset-sum over the held lengths (copies in powers
of two) finds the multiset that comes closest to the free capacity; going back
through the bitsets gives how many of each length to take.  What slack is left is
filled by the beginning of the longest remainder, whose rest stays held.  So every
sequence is full but those made of the last remainders of a task, which are cut into
powers of two and need no padding: padding is nothing.  Held are at most window + size
pieces, each shorter than a sequence.

Null texts count as empty (the end id alone).  Repeated rows are packed as often as
they occur.  Sequence ids are unique (task number and count), not gapless.  A lost
task packs the same rows the same way again.  An empty table gives none.  A very long
text is encoded at once, so its ids must fit in a worker; columns other than id and text
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import ids_and_texts, slices, sql_type, task, tokenizer_path
from sluice.llm.library_ids import library_ids


def closest_multiset(counts, capacity: int, lengths: list[int] | None = None) -> dict[int, int]:
    """Of the lengths with their counts, the multiset whose sum is the largest that is <= capacity.

    counts: length -> number, or things that have one; lengths: its keys in ascending order, if at hand.
    """
    lengths = sorted(counts) if lengths is None else lengths
    reach, layers, mask, goal = 1, [], (1 << (capacity + 1)) - 1, 1 << capacity
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[at]
        n = counts[length]
        left, copies = min(n if isinstance(n, int) else len(n), capacity // length), 1
        while left > 0 and not reach & goal:
            take = min(copies, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


class Packer:
    def __init__(self, size: int, window: int, first_sequence: int):
        self.size, self.window, self.sequence = size, window, first_sequence
        self.held: dict[int, deque] = {}
        self.lengths: list[int] = []  # its keys in order
        self.n_held = self.tokens = 0
        self.rows: list[tuple] = []

    def put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        data, n = memoryview(ids.astype("<u4", copy=False).tobytes()), len(ids)
        full = n // self.size * self.size
        for at in range(0, full, self.size):
            self.put([(doc, at, data[at * 4 : (at + self.size) * 4], n)])
        if n > full:
            self.hold((doc, full, bytes(data[full * 4 :]), n))
            if self.n_held >= self.window:
                self.fill(max(1, self.window // 2))

    def hold(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if length not in self.held:
            self.held[length] = deque()
            insort(self.lengths, length)
        self.held[length].append(piece)
        self.n_held += 1
        self.tokens += length

    def take(self, length: int) -> tuple:
        queue = self.held[length]
        got = queue.popleft()
        if not queue:
            del self.held[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.n_held -= 1
        self.tokens -= length
        return got

    def fill(self, down_to: int) -> None:
        """Make sequences until few enough remainders are held; short ones only once nothing else is held."""
        while self.n_held > down_to and (self.tokens >= self.size or not down_to):
            pieces = [self.take(self.lengths[-1])]
            free = self.size - len(pieces[0][2]) // 4
            chosen = closest_multiset(self.held, free, self.lengths)
            pieces += [self.take(k) for k, n in chosen.items() for _ in range(n)]
            slack = free - sum(k * n for k, n in chosen.items())
            if slack and self.held:  # all that are held are longer than the slack, or they would have been chosen
                doc, start, ids, n = self.take(self.lengths[-1])
                pieces.append((doc, start, ids[: slack * 4], n))
                self.hold((doc, start + slack, ids[slack * 4 :], n))
                slack = 0
            if slack:
                self.put_short(pieces)
            else:
                self.put(pieces)

    def put_short(self, line: list[tuple]) -> None:
        """Pieces that don't fill a sequence, cut at powers of two."""
        left = sum(len(x[2]) // 4 for x in line)
        line = line[::-1]
        while left:
            room, pieces = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, n = line.pop()
                if len(ids) // 4 > room:
                    line.append((doc, start + room, ids[room * 4 :], n))
                    ids = ids[: room * 4]
                pieces.append((doc, start, ids, n))
                room -= len(ids) // 4
            self.put(pieces)

    def finish(self) -> None:
        self.fill(0)


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, window: int = 4096, keep: int = 600_000, reuse: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start and length in the document, ids_crc32, doc_tokens, sequence_id, offset in the sequence.

    size must be a power of two; keep bounds the pre-tokens that a worker remembers, reuse lets it do so
    from one task to the next (memory against speed).
    """
    kind = sql_type(df, id_col)

    def run(batches):
        from pyspark import TaskContext

        encode, packer, id_type = library_ids(path, keep), None, None

        def out():
            cols = list(zip(*packer.rows, strict=True))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in slices(batches, 1 << 20):
            packer = packer or Packer(size, window, TaskContext.get().partitionId() << 40)
            id_type = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
            if packer.rows:
                yield out()
        if packer:
            packer.finish()
            if packer.rows:
                yield out()

    return ids_and_texts(df, id_col, text_col).mapInArrow(task(run, reuse), f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
