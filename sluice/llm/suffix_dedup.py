"""Repeated passages by sorted suffixes, over batches.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id.  All such strings (windows) of all documents would have to be
sorted; most need not be:

1. Rows are written once, in batches, to the shared folder; later steps read batches.
2. Every window has an anchor: the leftmost of its 20-byte substrings with the least
   hash.  Equal windows have equal anchors at equal places, and neighbouring windows
   share one, so there are about 1/15 as many anchors as bytes.  Batches send, for each
   distinct anchor with its context (the bytes of its windows; both as hashes of 48
   bits and more), the smallest id.  The anchor's task finds the smallest id of all.
3. If all contexts of an anchor are equal, so are their windows: done.  Else the
   contexts' bytes are sent, and their windows, as suffixes cut at LENGTH, are put in
   order by deep-shallow sorting: multikey quicksort, eight bytes at a time, to depth
   SHALLOW; then a blind trie for each group that still ties.  Neighbours with a common
   prefix of LENGTH bytes are one window; the smallest id among them decides.

A copy, passage or line in any number of documents is one entry for each batch and
context; nothing is capped.  Inside it, that is one for each batch.  At its edges contexts
reach into each document's own text and differ, so the task of an anchor there gets about
one for each document; an anchor isn't split over tasks.

A worker's memory goes with the bytes of one batch or one part, both bounded by BATCH
unless told otherwise; what is sorted is sorted AT_ONCE by ranges of parts (anchors) or
shares of a hash (windows), and removed bytes are kept as runs.

Null texts count as empty.  Ids must be integers; null ids count as larger than all
others; rows with equal ids don't remove from each other.  Texts under LENGTH bytes
stay whole.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, grouped, ids_and_texts, slices, staged, task, utf8

LENGTH, GRAM, SHALLOW = 50, 20, 24
BATCH = 16 << 20  # a batch's bytes at most, and the texts behind a part
AT_ONCE = 1 << 18  # anchors or windows that are sorted at a time
LAST = np.iinfo(np.int64).max  # a null id


# --- deep-shallow sorting -------------------------------------------------------------------------


class BlindTrie:
    """Orders distinct strings of equal length by the places where they part, then checks one leaf."""

    def __init__(self, strings: list[bytes]):
        self.s, self.root = strings, 0  # a leaf is an index; a branch is [place, {byte: child}]
        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        new, path, node = self.s[i], [], self.root
        while isinstance(node, list):  # blind: only the branching bytes are looked at
            path.append(node)
            node = node[1].get(new[node[0]]) if new[node[0]] in node[1] else next(iter(node[1].values()))
        old = self.s[node]
        part = next((k for k in range(len(new)) if new[k] != old[k]), None)
        if part is None:
            raise ValueError("strings must be distinct")
        parent, below = None, self.root
        for n in path:  # the branch at or below the place where they part
            if n[0] >= part:
                below = n
                break
            parent, below = n, n[1].get(new[n[0]])
        if isinstance(below, list) and below[0] == part:
            below[1][new[part]] = i
            return
        if below is None:
            parent[1][new[parent[0]]] = i
            return
        branch = [part, {old[part]: below, new[part]: i}]
        if parent is None:
            self.root = branch
        else:
            parent[1][new[parent[0]]] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    return np.ndarray((len(data) + 1,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def sort_windows(data: np.ndarray, start: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows data[s : s + length] in order, and for each whether it differs from the one before."""
    words = words_of(data) if words is None else words
    order, new = np.arange(len(start)), np.zeros(len(start), bool)
    if not len(start):
        return order, new
    new[0] = True
    for depth in range(0, shallow, 8):  # multikey quicksort with eight-byte characters: only equal parts go deeper
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            return order, new
        key = words[start[order[open_]] + depth].astype(np.uint64)
        at = np.lexsort((key, run[open_]))
        key = key[at]
        order[open_] = order[open_[at]]
        new[open_[1:]] |= (key[1:] != key[:-1])
        # open_ holds whole runs, so a boundary between runs was set before and stays
    rest = [words[start[order] + min(d, length - 8)].astype(np.uint64) for d in range(shallow, length, 8)]
    same = ~new
    for r in rest:
        same[1:] &= r[1:] == r[:-1]
    run = np.cumsum(new) - 1
    mixed = np.unique(run[~new & ~same])  # ties at the shallow depth that part deeper
    bounds = np.append(np.flatnonzero(new), len(new))
    for a, z in zip(bounds[mixed].tolist(), bounds[mixed + 1].tolist(), strict=True):
        own = order[a:z].tolist()
        text = [data[s + shallow : s + length].tobytes() for s in start[own].tolist()]
        distinct = list(dict.fromkeys(text))
        rank = {distinct[i]: k for k, i in enumerate(BlindTrie(distinct).order())}
        ranks = np.array([rank[t] for t in text])
        at = np.argsort(ranks, kind="stable")
        order[a:z] = order[a:z][at]
        new[a + 1 : z] |= np.diff(ranks[at]) > 0
    return order, new


# --- anchors --------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    w = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += w[GRAM - 8 : n + GRAM - 8]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Batch:
    """Documents in one buffer, with the anchors of their windows."""

    def __init__(self, table: pa.Table):
        texts = table.column(1).cast(pa.large_binary()).combine_chunks()
        self.rest = table.column(2).combine_chunks() if table.num_columns > 2 else None
        self.id_column = table.column(0).combine_chunks()
        self.ids = self.id_column.fill_null(LAST).to_numpy().astype(np.int64)
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.bounds = ends - ends[0]

    def find_anchors(self, piece: int = 1 << 20) -> None:
        """Piece by piece, to bound the working arrays; a run of windows cut by a piece's end counts as two contexts."""
        n = len(self.data) - LENGTH + 1
        place = np.int32 if n < 1 << 31 else np.int64
        found = [[np.zeros(0, place)] * 2 + [np.zeros(0, np.uint64)] * 2]
        for a in range(0, n, piece):
            first, last, key, context = self.anchors_in(a, min(a + piece, n))
            found.append([first.astype(place), last.astype(place), key, context])
        self.first, self.last, self.key, self.context = map(np.concatenate, zip(*found, strict=True))

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.bounds, places, side="right") - 1]

    def anchors_in(self, a: int, z: int):
        """First and last window, key and context hash of each anchor of the windows from a to z."""
        data, n = self.data[a : z + LENGTH - 1], z - a
        h = gram_hashes(data)
        span, value, place = 1, h, np.arange(len(h), dtype=np.int32)
        width = LENGTH - GRAM + 1
        while span < width:
            step = min(span, width - span)
            less = value[step:] < value[:-step]
            value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
            span += step
        d = np.searchsorted(self.bounds, [a, z - 1], side="right") - 1
        inner = np.clip(self.bounds[d[0] : d[1] + 2], a, z) - a
        doc_end = np.repeat(self.bounds[d[0] + 1 : d[1] + 2] - a, np.diff(inner))
        whole = doc_end - np.arange(n) >= LENGTH  # inside one document
        change = np.ones(n, bool)
        change[1:] = (place[1:n] != place[: n - 1]) | (whole[1:] != whole[:-1])
        change[inner[(inner > 0) & (inner < n)]] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], n) - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        at, end = place[first], last + LENGTH - GRAM
        mix = h[first]
        for k in (np.minimum(first + 20, end), np.minimum(first + 40, end), end):
            mix = (mix ^ (mix >> np.uint64(27))) * np.uint64(0x9FB21C651E98DF25) + h[k]
        shape = ((at - first) * 128 + (last - first)).astype(np.uint64)
        mix = (mix ^ shape) * np.uint64(0xD6E8FEB86659FD93)
        return first + a, last + a, h[at], mix ^ (mix >> np.uint64(32))

    def entries(self, parts: int):
        """Distinct (part, key, context) in order, by ranges of parts: their parts, keys, contexts and smallest ids; the range's anchors and the entry of each."""
        part = np.empty(len(self.key), np.int64)
        for a in range(0, len(part), AT_ONCE):
            key = self.key[a : a + AT_ONCE]
            low = (key & np.uint64(0xFFFF)) << np.uint64(16) | key >> np.uint64(16) & np.uint64(0xFFFF)  # led by bits that the key is sent without
            part[a : a + AT_ONCE] = low * np.uint64(parts) >> np.uint64(32)
        ranges = min(parts, -(-len(part) // AT_ONCE))
        for r in range(ranges):
            at = np.flatnonzero((part >= r * parts // ranges) & (part < (r + 1) * parts // ranges))
            if not len(at):
                continue
            own, key, ctx, ids = part[at], self.key[at] >> np.uint64(16), self.context[at] >> np.uint64(16), self.ids_at(self.first[at])
            order = np.lexsort((ids, ctx, key, own))
            p, k, c = own[order], key[order], ctx[order]
            new = np.ones(len(order), bool)
            new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            entry = np.empty(len(order), np.int64)
            entry[order] = np.cumsum(new) - 1
            yield p[new], k[new], c[new], ids[order][new], at, entry


def six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def narrow(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Ids as offsets from the least, in as few bytes as they need."""
    if not len(ids):
        return 0, 2, b""
    base, reach = int(ids.min()), int(ids.max()) - int(ids.min())
    width = 2 if reach < 1 << 16 else 4 if reach < 1 << 32 else 8
    return base, width, (ids.astype(object) - base if reach >= 1 << 62 else ids - base).astype(f"<u{width}").tobytes()


def widen(base: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.int64) + base


# --- steps ----------------------------------------------------------------------------------------


def files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def read_batch(folder: str, name: str) -> Batch:
    filesys, base = files(folder)
    with filesys.open_input_file(f"{base}/{name}.arrow") as f:
        return Batch(pa.ipc.open_stream(f).read_all())


def write_batches(batches, folder: str, batch_bytes: int):
    filesys, base = files(folder)
    filesys.create_dir(base, recursive=True)
    held, size = [], 0

    def write():
        name, table = uuid.uuid4().hex, pa.Table.from_batches(held)
        with filesys.open_output_stream(f"{base}/{name}.arrow") as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([name])], names=["batch"])

    for b in slices(batches, 1 << 20):
        raw = utf8(b.column(1).to_pylist())
        held.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "text"]) if b.num_columns == 2 else pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), b.column(2)], names=["id", "text", "rest"]))
        size += sum(map(len, raw))
        if size >= batch_bytes:
            yield write()
            held, size = [], 0
    if held:
        yield write()


ANCHORS = "part int, batch string, keys binary, contexts binary, base long, width int, ids binary"


SENT_SCHEMA = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("keys", pa.binary()), ("contexts", pa.binary()), ("base", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])


def send_anchors(batches, folder: str, parts: int):
    for name in (x for b in batches for x in b.column(0).to_pylist()):
        yield from anchors_of(name, folder, parts)


def anchors_of(name: str, folder: str, parts: int):
    batch = read_batch(folder, name)
    batch.find_anchors()
    if not len(batch.key):  # each batch sends something, so that it gets answers
        yield pa.RecordBatch.from_pylist([{"part": 0, "batch": name, "keys": b"", "contexts": b"", "base": 0, "width": 2, "ids": b""}], schema=SENT_SCHEMA)
    for part, key, ctx, ids, _, _ in batch.entries(parts):
        used, cuts = np.unique(part, return_index=True)
        rows = []
        for p, a, z in zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            base, width, packed = narrow(ids[a:z])
            rows.append({"part": p, "batch": name, "keys": six_bytes(key[a:z]), "contexts": six_bytes(ctx[a:z]), "base": base, "width": width, "ids": packed})
        yield pa.RecordBatch.from_pylist(rows, schema=SENT_SCHEMA)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


ANSWERS = "batch string, part int, places binary, least binary, several binary"


def answer_anchors(table: pa.Table) -> pa.Table:
    """For each sender: the entries with a smaller id elsewhere, or with other contexts under their anchor."""
    rows = table.to_pylist()
    key, ctx = (np.concatenate([from_six(r[c]) for r in rows]) for c in ("keys", "contexts"))
    ids = np.concatenate([widen(r["base"], r["width"], r["ids"]) for r in rows])
    sizes = np.array([len(r["keys"]) // 6 for r in rows])
    order = np.lexsort((ids, ctx, key))
    key = key[order]
    pairs, groups = heads(key, ctx[order]), heads(key)
    del key, ctx
    least = np.empty(len(ids), np.int64)
    several = np.empty(len(ids), bool)
    if len(ids):
        i = ids[order]
        contexts = np.diff(np.append(np.searchsorted(pairs, groups), len(pairs)))
        low, high = np.minimum.reduceat(i, groups), np.maximum.reduceat(i, groups)
        least[order] = np.repeat(i[pairs], np.diff(np.append(pairs, len(i))))
        several[order] = np.repeat((contexts > 1) & (low < high), np.diff(np.append(groups, len(i))))
        del i
    del order
    tell, at, out = several | (least < ids), 0, []
    for r, n in zip(rows, sizes.tolist(), strict=True):
        own = np.flatnonzero(tell[at : at + n])
        out.append({"batch": r["batch"], "part": r["part"], "places": own.astype("<u4").tobytes(), "least": least[at + own].astype("<i8").tobytes(), "several": np.packbits(several[at + own]).tobytes()})
        at += n
    return pa.Table.from_pylist(out, schema=pa.schema([("batch", pa.string()), ("part", pa.int32()), ("places", pa.binary()), ("least", pa.binary()), ("several", pa.binary())]))


STEP = "kind int, part int, batch string, a binary, b binary, c binary, d binary, e binary"
STEP_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.string()), *((c, pa.binary()) for c in "abcde")])


def use_answers(key, table: pa.Table, folder: str, parts: int) -> pa.Table:
    """A batch's spans that are decided (kind 0) and the contexts that must be compared (kind 1), with where they occur."""
    name = key[0].as_py()
    batch = read_batch(folder, name)
    batch.find_anchors()
    answers = {r["part"]: r for r in table.to_pylist()}
    gone, open_places, numbers, told, done = [], [], [], [], 0
    for part, _, _, least, at, entry in batch.entries(parts):
        several = np.zeros(len(part), bool)
        for p, a in zip(*(x.tolist() for x in np.unique(part, return_index=True)), strict=True):
            r = answers[p]
            places = a + np.frombuffer(r["places"], "<u4").astype(np.int64)
            least[places] = np.frombuffer(r["least"], "<i8")
            several[places] = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(places)).astype(bool)
        ids, open_ = batch.ids_at(batch.first[at]), several[entry]
        gone.append(at[~open_ & (ids > least[entry])])
        rest = np.flatnonzero(open_)
        # the contexts that must be compared, once each
        which, number = np.unique(entry[rest], return_inverse=True)
        sample = np.zeros(len(which), np.int64)
        sample[number] = at[rest]
        low, high = np.full(len(which), LAST), np.full(len(which), np.iinfo(np.int64).min)
        np.minimum.at(low, number, ids[rest])
        np.maximum.at(high, number, ids[rest])
        open_places.append(batch.first[at[rest]].astype("<u4"))
        numbers.append((number + done).astype("<u4"))
        own_part = part[which]
        for p in np.unique(own_part).tolist():
            own = np.flatnonzero(own_part == p)
            a, z = batch.first[sample[own]], batch.last[sample[own]] + LENGTH
            text = b"".join(batch.data[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True))
            told.append({"kind": 1, "part": p, "batch": name, "a": text, "b": (z - a).astype("u1").tobytes(), "c": (own + done).astype("<u4").tobytes(), "d": low[own].astype("<i8").tobytes(), "e": high[own].astype("<i8").tobytes()})
        done += len(which)
    gone = np.concatenate([np.zeros(0, np.int64), *gone])
    decided = {"kind": 0, "part": -1, "batch": name, "a": batch.first[gone].astype("<u4").tobytes(), "b": (batch.last[gone] + LENGTH).astype("<u4").tobytes(), "c": b"".join(open_places), "d": b"".join(numbers), "e": b""}
    return pa.Table.from_pylist([decided, *told], schema=STEP_SCHEMA)


def least_ids(data: np.ndarray, start: np.ndarray, owner: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest id of each window's equals.  Windows are sorted a share at a time, by a hash: equal ones are in one share."""
    words = words_of(data)
    shares = -(-len(start) // AT_ONCE)
    share = np.empty(len(start), np.int32)
    for a in range(0, len(start), AT_ONCE):
        s = start[a : a + AT_ONCE]
        h = sum(words[s + d].astype(np.uint64) * np.uint64(f) for d, f in ((0, 0x9E3779B97F4A7C15), (LENGTH // 2, 0xBF58476D1CE4E5B9), (LENGTH - 8, 0x94D049BB133111EB)))
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        share[a : a + AT_ONCE] = (h >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
    least = np.empty(len(start), np.int64)
    for k in range(shares):
        at = np.flatnonzero(share == k)
        if len(at):
            order, new = sort_windows(data, start[at], words=words)
            least[at[order]] = np.minimum.reduceat(low[owner[at[order]]], np.flatnonzero(new))[np.cumsum(new) - 1]
    return least


def compare_contexts(table: pa.Table) -> pa.Table:
    """Sort the windows of all contexts; tell senders which have a smaller id elsewhere (kind 2), in runs."""
    rows = table.to_pylist()
    data = np.frombuffer(b"".join(r.pop("a") for r in rows), np.uint8)
    size = np.concatenate([np.frombuffer(r["b"], "u1") for r in rows]).astype(np.int64)
    low, high = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in "de")
    begin = np.cumsum(size) - size
    count = size - LENGTH + 1
    owner = np.repeat(np.arange(len(size), dtype=np.int32), count)
    before = np.cumsum(count) - count  # windows of the contexts before
    start = np.arange(len(owner)) + np.repeat(begin - before, count)
    least = least_ids(data, start, owner, low)
    del start
    hit = np.flatnonzero(least < high[owner])
    owner, least = owner[hit], least[hit]
    first = heads(owner, least, hit - np.arange(len(hit)))  # of windows in a row
    lengths = np.diff(np.append(first, len(hit)))
    owner, least = owner[first].astype(np.int64), least[first]
    inside = hit[first] - before[owner]
    out, at = [], 0
    for r in rows:
        index, n = np.frombuffer(r["c"], "<u4"), len(r["b"])
        own = slice(*np.searchsorted(owner, [at, at + n]))
        out.append({"kind": 2, "part": r["part"], "batch": r["batch"], "a": index[owner[own] - at].tobytes(), "b": inside[own].astype("u1").tobytes(), "c": lengths[own].astype("u1").tobytes(), "d": least[own].astype("<i8").tobytes(), "e": b""})
        at += n
    return pa.Table.from_pylist(out, schema=STEP_SCHEMA)


def removed_runs(batch: Batch, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes, in order: where they begin and end, and the document of each."""
    rows = table.to_pylist()
    base = next(r for r in rows if r["kind"] == 0)
    begins, ends = [np.frombuffer(base["a"], "<u4").astype(np.int64)], [np.frombuffer(base["b"], "<u4").astype(np.int64)]
    place, number = np.frombuffer(base["c"], "<u4").astype(np.int64), np.frombuffer(base["d"], "<u4").astype(np.int64)
    order = np.argsort(number, kind="stable")
    place, number = place[order], number[order]
    ids = batch.ids_at(place)
    for r in rows:
        if r["kind"] == 2:
            ctx, offset, count, least = np.frombuffer(r["a"], "<u4").astype(np.int64), np.frombuffer(r["b"], "u1").astype(np.int64), np.frombuffer(r["c"], "u1").astype(np.int64), np.frombuffer(r["d"], "<i8")
            a, z = np.searchsorted(number, ctx), np.searchsorted(number, ctx, side="right")
            reps = z - a
            which = np.repeat(np.arange(len(ctx)), reps)
            occ = np.repeat(a - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            own = ids[occ] > least[which]
            start = place[occ[own]] + offset[which[own]]
            begins.append(start)
            ends.append(start + count[which[own]] - 1 + LENGTH)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    del rows, begins, ends
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    doc = np.searchsorted(batch.bounds, begin, side="right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(first) else end, doc[first]


def kept_texts(batch: Batch, begin: np.ndarray, end: np.ndarray, doc: np.ndarray):
    """The remaining bytes of each document, one after the other."""
    data, cuts = memoryview(batch.data), np.searchsorted(doc, np.arange(len(batch.ids) + 1)).tolist()
    begin, end, bounds = begin.tolist(), end.tolist(), batch.bounds.tolist()
    for d, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        yield b"".join(data[x:y] for x, y in zip([bounds[d], *end[a:z]], [*begin[a:z], bounds[d + 1]], strict=True))


def finish_batch(key, table: pa.Table, folder: str, texts: bool) -> pa.Table:
    batch = read_batch(folder, key[0].as_py())
    begin, end, doc = removed_runs(batch, table)
    n = len(batch.ids)
    n_removed = np.bincount(doc, end - begin, n).astype(np.int64)
    hashes, kept = [], []
    for k in kept_texts(batch, begin, end, doc):
        hashes.append(hashlib.sha256(k).hexdigest())
        if texts:
            kept.append(k)
    cols = [batch.id_column.cast(pa.int64()), pa.array(np.diff(batch.bounds), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(hashes, pa.string())]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if texts:
        cols.append(pa.array(kept, pa.binary()))
        names.append("kept")
    if batch.rest is not None:
        cols.append(batch.rest)
        names.append("rest")
    return pa.Table.from_arrays(cols, names=names)


def batch_size(df: DataFrame, least: int = 8 << 20, most: int = BATCH) -> int:
    """Bytes a batch: grows as the root of the input, so that batches x parts grows in proportion until ``most``, a matter of worker memory."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(most, math.isqrt(size << 17)))


def remove_repeats(df: DataFrame, batch_bytes: int | None = None, parts: int | None = None, texts: bool = False, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256); if asked for, the remaining bytes as ``kept`` and other columns in ``rest``."""
    spark = df.sparkSession
    folder, batch_bytes = fresh_path(spark, "suffix-batches"), batch_bytes or batch_size(df)
    rows = ids_and_texts(df, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    if carry:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest"))
    @task
    def write(batches):
        yield from write_batches(batches, folder, batch_bytes)

    @task
    def send(batches):
        yield from send_anchors(batches, folder, parts)

    @grouped
    def answer(key, table):
        return answer_anchors(table)

    @grouped
    def use(key, table):
        return use_answers(key, table, folder, parts)

    @grouped
    def compare(key, table):
        return compare_contexts(table)

    @grouped
    def finish(key, table):
        return finish_batch(key, table, folder, texts)

    manifest = staged(rows.mapInArrow(write, "batch string"), "suffix-manifest")
    n = manifest.count()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * min(batch_bytes, BATCH) // BATCH))
    sent = manifest.repartition(max(1, n), "batch").mapInArrow(send, ANCHORS)
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, ANSWERS)
    step = staged(answers.repartition(max(1, n), "batch").groupBy("batch").applyInArrow(use, STEP), "suffix-step")
    compared = step.filter("kind = 1").repartition(parts, "part").groupBy("part").applyInArrow(compare, STEP)
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts + (f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else "")
    return step.filter("kind = 0").unionByName(compared).repartition(max(1, n), "batch").groupBy("batch").applyInArrow(finish, out)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **how) -> DataFrame:
    """The rows with their repeated passages taken out of the text (a character that lost a byte goes); rows of which nothing is left go.

    Other columns stay, but for size_col, which gets the new number of characters.
    """
    others = [c for c in df.columns if c != text_col]
    got = remove_repeats(df, texts=True, carry=others, id_col=id_col, text_col=text_col, **how)
    got = got.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    got = got.mapInArrow(decode_kept, f"kept_text string, rest {got.schema['rest'].dataType.simpleString()}")
    cols = [F.col("kept_text") if c == text_col else F.length("kept_text").cast(df.schema[c].dataType) if c == size_col else F.col("rest").getField(c) for c in df.columns]
    return got.select(*(x.alias(c) for x, c in zip(cols, df.columns, strict=True)))


def decode_kept(batches):
    for b in batches:
        at = b.schema.get_field_index
        texts = [k.decode("utf-8", "ignore") for k in b.column(at("kept")).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(at("rest"))], names=["kept_text", "rest"])


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
