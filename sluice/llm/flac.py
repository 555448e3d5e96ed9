"""FLAC media columns: encode, decode, verify, seek.

One channel of 8-bit samples (a byte less 128).  Frames of equal size are lanes of
numpy arrays: a step of the Rice decoder, of the linear predictor or of a checksum
works on that step of all frames of a slice at once.  The encoder takes, for each
frame, the cheapest of a constant, fixed predictors of order 1 and 2, a quantised
linear predictor of order ``LPC_ORDER`` from its autocorrelation, and plain samples.
The decoder reads constant, verbatim, fixed (0 to 4) and LPC (1 to 32) subframes with
any Rice partitions (4 or 5 bit parameters), finds frames by their headers' CRC-8
and running number, and checks the CRC-16 of each and the MD5 of the whole; anything
wrong raises.  Blocks of PCM come with their sample offsets, and a seek table in the
stream has the byte offset of every ``SEEK_FRAMES``-th frame.

Null media and null texts count as empty payloads where the payload is made from a
text (one block of blanks); repeated rows come back as often; an empty table gives an
empty one; columns other than id and text (or media) are not read.  Very long texts are
encoded ``LANES`` frames at a time and decoded in stretches between seek points, so that
working arrays don't grow with one text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ids_and_texts, slices, sql_type, task, utf8

BLOCK = 192  # samples in a frame; block size code 1
LPC_ORDER, PRECISION, SEEK_FRAMES, RATE = 6, 10, 64, 8000
LANES = 1 << 13  # frames worked on at once; a multiple of SEEK_FRAMES
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        table.append(c)
    return np.array(table, np.uint8 if bits == 8 else np.uint16)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc_lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of data[start:end] for all lanes; leading zeros don't change them, so lanes are aligned at their ends."""
    if not len(start):
        return np.zeros(0, table.dtype)
    longest, crc = int((end - start).max()), np.zeros(len(start), table.dtype)
    at = end - longest
    for _ in range(longest):
        b = np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.uint8)
        crc = table[crc ^ b] if table is CRC8 else (crc << 8) ^ table[(crc >> 8).astype(np.uint8) ^ b]
        at += 1
    return crc


def coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: value, bytes."""
    size = 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    value = np.zeros(len(n), np.int64)
    for k in range(1, 7):
        own = size == k
        v = n[own].astype(np.int64)
        out = v if k == 1 else ((0xFF << (8 - k) & 0xFF) | (v >> (6 * (k - 1)))) << (8 * (k - 1))
        for j in range(k - 1):
            out = out | (0x80 | (v >> (6 * j) & 0x3F)) << (8 * j)
        value[own] = out
    return value, size


def best_rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """residual (n, lanes) -> folded values, parameter, bits."""
    u = (residual << 1) ^ (residual >> 31)
    n, total = len(u), u.sum(axis=0, dtype=np.int64)
    k = np.clip(np.floor(np.log2(np.maximum(total / max(n, 1), 1))).astype(np.int32), 0, 14)
    lower = np.maximum(k - 1, 0)
    bits = (u >> k).sum(axis=0, dtype=np.int64) + n * (1 + k)
    bits_lower = (u >> lower).sum(axis=0, dtype=np.int64) + n * (1 + lower)
    return u, np.where(bits_lower < bits, lower, k), np.minimum(bits, bits_lower)


def linear_predictor(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (order, lanes) and shifts from windowed autocorrelation (Levinson and Durbin)."""
    n, lanes = x.shape
    w = (x * (1 - np.linspace(-0.98, 0.98, n) ** 2)[:, None]).astype(np.float32)
    r = np.stack([np.einsum("ij,ij->j", w[: n - k], w[k:]) for k in range(order + 1)]).astype(np.float64)
    a, err = np.zeros((order, lanes)), np.maximum(r[0], 1e-9) * 1.0001
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i] = a[:i] - k * a[:i][::-1].copy()
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int32)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit, limit).astype(np.int32), shift


def predicted(x: np.ndarray, coef: np.ndarray, shift) -> np.ndarray:
    n, order = len(x), len(coef)
    p = np.zeros((n - order, x.shape[1]), np.int32)
    for j in range(order):
        p += coef[j] * x[order - 1 - j : n - 1 - j]
    return p >> shift


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples int32 (lanes, BLOCK), frame numbers -> bytes of all frames in a row, and where each starts (and the end)."""
    x = np.ascontiguousarray(samples.T)
    lanes = x.shape[1]
    coef, shift = linear_predictor(x, LPC_ORDER)
    res = {1: x[1:] - x[:-1], 2: x[2:] - 2 * x[1:-1] + x[:-2], "lpc": x[LPC_ORDER:] - predicted(x, coef, shift)}
    rice = {kind: best_rice(r) for kind, r in res.items()}
    cost = np.stack([rice[1][2] + 18, rice[2][2] + 26, rice["lpc"][2] + 19 + LPC_ORDER * (8 + PRECISION), np.full(lanes, 8 * BLOCK + 1)])
    choice = cost.argmin(axis=0)
    choice[(x == x[0]).all(axis=0)] = 4

    coded, nbytes = coded_number(number)
    header = np.zeros((lanes, 10), np.uint8)  # right-aligned: sync, codes, number
    for k in range(6):
        header[:, 9 - k] = np.where(k < nbytes, coded >> (8 * k) & 0xFF, 0)
    first = 10 - nbytes - 4
    for k, b in enumerate((0xFF, 0xF8, 0x10, 0x02)):  # block size code 1, rate of the stream, one channel, 8 bits
        header[np.arange(lanes), first + k] = b
    crc8 = np.zeros(lanes, np.uint8)
    for k in range(10):
        crc8 = CRC8[crc8 ^ header[:, k]]
    shared = [(np.full(lanes, 0xFFF81002), np.full(lanes, 32)), (coded >> 24, np.maximum(nbytes * 8 - 24, 0)), (coded & 0xFFFFFF, np.minimum(nbytes * 8, 24)), (crc8.astype(np.int64), np.full(lanes, 8))]

    groups, size_bits = [], np.zeros(lanes, np.int64)
    for c in range(5):
        own = np.flatnonzero(choice == c)
        if not len(own):
            continue
        m, values, lengths = len(own), [v[own] for v, _ in shared], [n[own] for _, n in shared]

        def put(v, n, m=m, values=values, lengths=lengths):
            values.append(np.broadcast_to(np.asarray(v, np.int64), m))
            lengths.append(np.broadcast_to(np.asarray(n, np.int64), m))

        kind = {0: 1, 1: 2, 2: "lpc"}.get(c)
        order = {0: 1, 1: 2, 2: LPC_ORDER}.get(c, 0)
        put({0: 9, 1: 10, 2: 31 + LPC_ORDER, 3: 1, 4: 0}[c] << 1, 8)
        for k in range({3: BLOCK, 4: 1}.get(c, order)):
            put(x[k, own] & 0xFF, 8)
        if kind == "lpc":
            put(PRECISION - 1, 4)
            put(shift[own], 5)
            for j in range(order):
                put(coef[j, own] & ((1 << PRECISION) - 1), PRECISION)
        if kind:
            put(0, 6)  # 4-bit parameters, one partition
            u, k, _ = rice[kind]
            u, k = u[:, own].astype(np.int64), k[own].astype(np.int64)
            put(k, 4)
            values, lengths = np.concatenate([np.stack(values), (1 << k) | (u & ((1 << k) - 1))]), np.concatenate([np.stack(lengths), (u >> k) + 1 + k])
        else:
            values, lengths = np.stack(values), np.stack(lengths)
        ends = lengths.cumsum(axis=0)
        size_bits[own] = ends[-1]
        groups.append((own, values, ends))
    size = (size_bits + 7) // 8 + 2
    start = np.concatenate([[0], size.cumsum()])
    words = np.zeros(int(start[-1]) // 4 + 3)
    for own, values, ends in groups:
        # a field's significant bits end at its end; zeros before it need no writing
        stop = (ends + start[own] * 8).ravel()
        v = values.ravel()
        keep = v != 0
        stop, v = stop[keep], v[keep].astype(np.uint64)
        word = (stop - 1) >> 5
        spread = v << (31 - ((stop - 1) & 31)).astype(np.uint64)
        words += np.bincount(word, weights=(spread & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))
        high = (spread >> np.uint64(32)).astype(np.float64)
        over = high > 0
        words += np.bincount(word[over] - 1, weights=high[over], minlength=len(words))
    data = words.astype(">u4").view(np.uint8)[: start[-1]].copy()
    crc = crc_lanes(data, start[:-1], start[1:] - 2, CRC16)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 0xFF
    return data, start


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose length must be a positive multiple of BLOCK."""
    if not payloads:
        return []
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    frames = np.array([len(p) // BLOCK for p in payloads])
    bounds = np.concatenate([[0], frames.cumsum()])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], frames)
    blob, start = bytearray(), [np.zeros(1, np.int64)]
    for at in range(0, len(number), LANES):
        data, places = encode_frames(raw[at * BLOCK : (at + LANES) * BLOCK].reshape(-1, BLOCK).astype(np.int32) - 128, number[at : at + LANES])
        start.append(places[1:] + len(blob))
        blob += data.tobytes()
    start, blob, out = np.concatenate(start), memoryview(blob), []
    for p, a, z in zip(payloads, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sizes, md5 = np.diff(start[a : z + 1]), hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        points = b"".join(struct.pack(">QQH", k * BLOCK, int(start[a + k] - start[a]), BLOCK) for k in range(0, z - a, SEEK_FRAMES))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + blob[start[a] : start[z]])
    return out


def crc16(data: bytes) -> int:
    c, table = 0, CRC16.tolist()
    for b in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    return c


def read_header(stream: bytes) -> dict:
    """Stream information, seek points (sample, byte from the first frame) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, got = 4, False, {"seek": []}
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            bits = int.from_bytes(body[10:18], "big")
            got |= {"block": int.from_bytes(body[2:4], "big"), "rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "bits": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            got["seek"] = [p[:2] for p in struct.iter_unpack(">QQH", body)]
        at += 4 + size
    if (got.get("channels"), got.get("bits")) != (1, 8):
        raise ValueError("one channel of 8 bits is what this decoder reads")
    return got | {"first": at}


def find_frames(data: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For data with streams' frames at bounds, numbered from base: each frame's stream, start, end, place of its subframe, block size."""
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    at = at[at + 18 <= len(data)]
    lead = data[at + 4]
    nb = np.select([lead < 0x80, (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), (lead >= 0xF0) & (lead < 0xF8), (lead >= 0xF8) & (lead < 0xFC), (lead >= 0xFC) & (lead < 0xFE)], [1, 2, 3, 4, 5, 6], 0)
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    more = np.select([code == 6, code == 7], [1, 2], 0)
    length = 4 + nb + more + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    good = (nb > 0) & (code > 0) & (rate < 15) & (data[at + 3] >> 4 == 0)
    at, nb, code, more, length = at[good], nb[good], code[good], more[good], length[good]
    good = crc_lanes(data, at, at + length + 1, CRC8) == 0
    at, nb, code, more, length = at[good], nb[good], code[good], more[good], length[good]
    number = data[at + 4].astype(np.int64) & np.where(nb == 1, 0x7F, 0x7F >> nb)
    for k in range(1, 6):
        number = np.where(k < nb, number << 6 | (data[at + 4 + np.minimum(k, 8)] & 0x3F), number)
    explicit = np.where(more == 1, data[at + 4 + nb].astype(np.int64), (data[at + 4 + nb].astype(np.int64) << 8) | data[at + 5 + nb]) + 1
    block = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.clip(code.astype(np.int64) - 2, 0, 3), 256 << np.clip(code.astype(np.int64) - 8, 0, 7)], explicit)
    stream = np.searchsorted(bounds, at, side="right") - 1
    # frames of a stream are numbered in a row; what only looks like a header is out of step
    first = np.searchsorted(stream, np.arange(len(bounds) - 1))
    if len(at) and (number == np.arange(len(at)) - first[stream] + base[stream]).all():
        chosen = np.arange(len(at))
    else:
        keep, expected, on = [], 0, -1
        for i, (s, n) in enumerate(zip(stream.tolist(), number.tolist(), strict=True)):
            expected = base[s] if s != on else expected
            on = s
            if n == expected:
                keep.append(i)
                expected += 1
        chosen = np.array(keep, np.int64)
    end = np.append(at[chosen][1:], bounds[-1])
    lasts = np.append(stream[chosen][1:] != stream[chosen][:-1], True)
    end = np.where(lasts, bounds[stream[chosen] + 1], end)
    bad = set(stream[chosen][crc_lanes(data, at[chosen], end, CRC16) != 0].tolist())
    if bad:  # a false header in step: step through these streams by checksum
        picked = [i for i in chosen.tolist() if stream[i] not in bad]
        for s in sorted(bad):
            own, where, expected = np.flatnonzero(stream == s).tolist(), int(bounds[s]), int(base[s])
            by_place = {int(at[i]): i for i in own}
            while where < bounds[s + 1]:
                ends = [int(at[i]) for i in own if at[i] > where and number[i] == expected + 1] + [int(bounds[s + 1])]
                stop = next((e for e in ends if crc16(data[where:e].tobytes()) == 0), None)
                if stop is None or where not in by_place:
                    raise ValueError("frame checksum")
                picked.append(by_place[where])
                where, expected = stop, expected + 1
        chosen = np.array(sorted(picked), np.int64)
        end = np.append(at[chosen][1:], bounds[-1])
        lasts = np.append(stream[chosen][1:] != stream[chosen][:-1], True)
        end = np.where(lasts, bounds[stream[chosen] + 1], end)
    return stream[chosen], at[chosen], end, at[chosen] + length[chosen] + 1, block[chosen]


class Bits:
    """Reads from many places of one buffer at once."""

    def __init__(self, data: np.ndarray, place: np.ndarray):
        raw = np.concatenate([data, np.zeros(16, np.uint8)])
        self.window = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        self.at = place.astype(np.int64) * 8

    def peek(self) -> np.ndarray:
        return self.window[self.at >> 3].astype(np.uint64) << (self.at & 7).astype(np.uint64)

    def take(self, n: int) -> np.ndarray:
        got = (self.peek() >> np.uint64(64 - n)).astype(np.int32) if n else np.zeros(len(self.at), np.int32)
        self.at += n
        return got

    def signed(self, n: int) -> np.ndarray:
        got = self.take(n)
        return got - ((got >> (n - 1)) << n)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """One code of each lane."""
        w = self.peek()
        high = (w >> np.uint64(32)).astype(np.float64)
        q = 1054 - (high.view(np.int64) >> 52)  # 31 less the exponent
        if (slow := np.flatnonzero(high == 0)).size:
            for i in slow.tolist():
                n, at = 0, int(self.at[i])
                while not int(self.window[at >> 3]) >> (63 - (at & 7)) & 1:
                    n, at = n + 1, at + 1
                q[i] = 0
                self.at[i] = at
                slow_q = n
                w[i] = np.uint64(int(self.window[at >> 3]) << (at & 7) & (1 << 64) - 1)
                high[i] = slow_q
            r = (w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
            self.at += q + 1 + k
            q[slow] = high[slow].astype(np.int64)
        else:
            r = (w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
            self.at += q + 1 + k
        u = (q << k) | r.astype(np.int64)
        return ((u >> 1) ^ -(u & 1)).astype(np.int32)


def decode_group(data: np.ndarray, place: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Samples (n, lanes) of subframes of one type."""
    bits, lanes = Bits(data, place), len(place)
    x = np.zeros((n, lanes), np.int32)
    if kind & 1:
        raise ValueError("wasted bits are not used with 8-bit samples here")
    kind >>= 1
    if kind == 0:
        x[:] = bits.signed(8)
        return x
    if kind == 1:
        for i in range(n):
            x[i] = bits.signed(8)
        return x
    order = kind - 31 if kind >= 32 else kind - 8
    if not (kind >= 32 or 8 <= kind <= 12) or order > n:
        raise ValueError("reserved subframe type")
    for i in range(order):
        x[i] = bits.signed(8)
    if kind >= 32:
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coef = np.zeros((order, lanes), np.int32)
        for p in np.unique(precision).tolist():
            own = np.flatnonzero(precision == p)
            part = Bits.__new__(Bits)
            part.window, part.at = bits.window, bits.at[own]
            for j in range(order):
                coef[j, own] = part.signed(p)
            bits.at[own] = part.at
    else:
        coef, shift = np.repeat(np.array(FIXED[order], np.int32)[:, None], lanes, axis=1), np.zeros(lanes, np.int32)
    method, split = bits.take(2), bits.take(4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    width, part_len = np.where(method == 0, 4, 5), n >> split
    k, raw = np.zeros(lanes, np.int64), np.full(lanes, -1, np.int64)
    one = not split.any()
    for i in range(order, n):
        if i == order or not one:
            fresh = np.flatnonzero(i % part_len == 0) if i != order else np.arange(lanes)
            for lane_width in (4, 5):
                own = fresh[width[fresh] == lane_width]
                if own.size:
                    part = Bits.__new__(Bits)
                    part.window, part.at = bits.window, bits.at[own]
                    k[own] = part.take(lane_width)
                    escaped = k[own] == (1 << lane_width) - 1
                    raw[own] = -1
                    if escaped.any():
                        part.at = part.at[escaped]
                        raw[own[escaped]] = part.take(5)
                        bits.at[own] += lane_width + 5 * escaped
                    else:
                        bits.at[own] = part.at
        if (raw >= 0).any():
            r = np.zeros(lanes, np.int32)
            for size in np.unique(raw).tolist():
                own = np.flatnonzero(raw == size)
                part = Bits.__new__(Bits)
                part.window, part.at = bits.window, bits.at[own]
                r[own] = part.rice(k[own]) if size < 0 else part.signed(size) if size else 0
                bits.at[own] = part.at
        else:
            r = bits.rice(k)
        p = np.zeros(lanes, np.int32)
        for j in range(order):
            p += coef[j] * x[i - 1 - j]
        x[i] = r + (p >> shift)
    return x


def decode_streams(streams: list[bytes], verify: bool = True) -> list[np.ndarray]:
    """Samples (int8) of each stream."""
    heads = [read_header(s) for s in streams]
    parts = [(i, s[h["first"] + a : h["first"] + z], n) for i, (s, h) in enumerate(zip(streams, heads, strict=True)) for a, z, n in segments(len(s) - h["first"], h)]
    got: list[list[np.ndarray]] = [[] for _ in streams]
    while parts:
        size, k = 0, 0
        while k < len(parts) and (not k or size + len(parts[k][1]) <= LANES * BLOCK):
            size, k = size + len(parts[k][1]), k + 1
        for (i, _, _), x in zip(parts[:k], decode_segments([p[1] for p in parts[:k]], [p[2] for p in parts[:k]]), strict=True):
            got[i].append(x)
        parts = parts[k:]
    got = [np.concatenate(x) if x else np.zeros(0, np.int8) for x in got]
    for x, h in zip(got, heads, strict=True):
        if verify and (len(x) != h["samples"] or hashlib.md5(x.tobytes()).digest() != h["md5"]):
            raise ValueError("stream checksum")
    return got


def segments(size: int, head: dict) -> list[tuple[int, int, int]]:
    """A stream's frames in stretches between seek points: first byte, end, number of the first frame; one, if it is short or has no points."""
    cuts = [(byte, sample // head["block"]) for sample, byte in head["seek"] if head["block"] and sample % (LANES // 2 * head["block"]) == 0]
    if not cuts or cuts[0] != (0, 0):
        cuts = [(0, 0)]
    return [(a, z, n) for (a, n), z in zip(cuts, [*(c[0] for c in cuts[1:]), size], strict=True)]


def decode_segments(found: list[bytes], base: list[int]) -> list[np.ndarray]:
    """Samples of stretches of frames, each numbered from its base."""
    data = np.frombuffer(b"".join(found), np.uint8)
    bounds = np.cumsum([0, *map(len, found)])
    stream, _, _, place, block = find_frames(np.concatenate([data, np.zeros(20, np.uint8)]), bounds, np.array(base, np.int64))
    offset = np.concatenate([[0], block.cumsum()])
    out, kinds = np.zeros(offset[-1], np.int8), data[place]
    for n in np.unique(block).tolist():
        for kind in np.unique(kinds[block == n]).tolist():
            own = np.flatnonzero((block == n) & (kinds == kind))
            x = decode_group(data, place[own] + 1, n, kind)
            out[offset[own][:, None] + np.arange(n)] = x.T
    ends = np.bincount(stream, weights=block, minlength=len(found)).astype(np.int64).cumsum()
    return [out[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def flac_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, padded with blanks to whole blocks, as a stream."""

    @task
    def run(batches):
        for b in slices(batches, 1 << 20):
            raw = utf8(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_streams([padded(x) for x in raw]), pa.binary())], names=["id", "n_bytes", "media"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"id {sql_type(df, id_col)}, n_bytes long, media binary")


def flac_blocks(df: DataFrame, id_col: str = "id", media_col: str = "media", block_samples: int = 4096) -> DataFrame:
    """PCM in blocks: (id, sample_offset, n_samples, pcm binary, signed 8-bit).  Null media give no rows."""

    @task
    def run(batches):
        for b in slices(batches, 1 << 20):
            for i, x in zip(b.column(0).to_pylist(), decode_streams(b.column(1).to_pylist()), strict=True):
                at = list(range(0, len(x), block_samples))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), b.column(0).type), pa.array(at, pa.int64()), pa.array([min(block_samples, len(x) - a) for a in at], pa.int32()), pa.array([x[a : a + block_samples].tobytes() for a in at], pa.binary())], names=["id", "sample_offset", "n_samples", "pcm"])

    chosen = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media")).filter("media is not null")
    return chosen.mapInArrow(run, f"id {sql_type(df, id_col)}, sample_offset long, n_samples int, pcm binary")


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first .. first + count, decoding only from the seek point before them."""
    h = read_header(stream)
    sample, byte = max((p for p in h["seek"] if p[0] <= first), default=(0, 0))
    after = [p for p in h["seek"] if p[0] >= first + count]
    data = np.frombuffer(stream[h["first"] + byte : h["first"] + min(after)[1] if after else len(stream)], np.uint8)
    place, got, at, number = 0, [], sample, sample // h["block"]
    padded_data = np.concatenate([data, np.zeros(20, np.uint8)])
    while place < len(data) and at < first + count:
        nb = int(coded_number(np.array([number]))[1][0])
        stop = place + 4 + nb + 1
        kind = int(data[stop])
        x = decode_group(padded_data, np.array([stop + 1]), h["block"], kind)[:, 0]
        got.append(x)
        at, number = at + len(x), number + 1
        nxt = coded_number(np.array([number]))[0][0].item()
        head = bytes((0xFF, 0xF8, 0x10, 0x02)) + nxt.to_bytes(int(coded_number(np.array([number]))[1][0]), "big")
        place = next((e for e in (m + place for m in _finds(data[place:].tobytes(), head)) if crc16(data[place:e].tobytes()) == 0), len(data))
    line = np.concatenate(got) if got else np.zeros(0, np.int32)
    return line[first - sample : first - sample + count].astype(np.int8)


def _finds(data: bytes, what: bytes):
    at = data.find(what, 1)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def features(x: np.ndarray) -> str:
    """Loudness, level, peak and zero crossings of the samples, from exact integer sums."""
    square = total = peak = crossings = 0
    for at in range(0, len(x), 1 << 20):
        y = x[max(at - 1, 0) : at + (1 << 20)].astype(np.int64)
        crossings += int(((y[1:] < 0) != (y[:-1] < 0)).sum())
        y = y[1 if at else 0 :]
        square, total, peak = square + int((y * y).sum()), total + int(y.sum()), max(peak, int(np.abs(y).max()))
    return f"rms={np.sqrt(square / len(x)):.6f};mean={total / len(x):.6f};peak={peak};crossings={crossings}"


def media_digests(encoded: DataFrame) -> DataFrame:
    """What flac_encode made, read back: the digest columns of the query."""
    import zlib

    @task
    def run(batches):
        for b in slices(batches, 1 << 20):
            media, rows = b.column(2).to_pylist(), []
            for m, x in zip(media, decode_streams(media), strict=True):
                payload = (x.view(np.uint8) ^ 128).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(x)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return encoded.mapInArrow(run, f"id {sql_type(encoded, 'id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_flac(spark, sf_dir):
    return media_digests(flac_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")
