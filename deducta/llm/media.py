"""Media columns: FLAC streams of 8-bit mono samples, written, read and seeked in numpy.

The codec works on many frames at once: one step handles the same sample of every frame, so that Rice codes and
linear predictors, which are sequential inside a frame, need no Python loop over samples times frames. Each frame's
CRC-8 and CRC-16 and the stream's MD5 are verified; a seek table gives the sample and byte offset of every frame, so a
part of a stream is read without what lies before it. Frames are coded and decoded in groups of BATCH_SAMPLES, over
texts and within one, so what a task holds besides a text and its stream doesn't grow with the text; what is read back
comes as PCM blocks, one for each frame, with their sample offsets.

Defined results: a null or empty text is 192 blanks; equal texts give equal streams; a damaged stream raises ValueError
from decode(), and from pcm_blocks() gives one row with its error instead of blocks; a null stream gives an error row.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, key_schema, table, text_or_empty

#: Samples in a frame, and in those of streams that would have more than MOST_SEEK frames (a seek table's length has 24 bits);
#: payloads are multiples of UNIT bytes.
BLOCK, LONG_BLOCK, UNIT, MOST_SEEK = 1152, 4608, 192, 900_000
RATE = 8000
#: Samples that are coded at once in a task.
BATCH_SAMPLES = 4_000_000
LPC_ORDER, LPC_PRECISION = 4, 10


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc_many(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """CRC of many slices of data, a byte of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, left, c = starts[order], sizes[order], np.zeros(len(order), dtype=np.uint32)
    active = len(order)
    for t in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left[:active], -t, side="left"))
        x = data[at[:active] + t]
        c[:active] = _CRC8[c[:active] ^ x] if bits == 8 else ((c[:active] << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c[:active] >> np.uint32(8)) ^ x]
    out = np.empty_like(c)
    out[order] = c
    return out


def _frame_number(n: int) -> bytes:
    """The extended UTF-8 coding of a frame's number, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1), *tail])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = 8 - (first ^ 0xFF).bit_length()
    if size < 2:
        raise ValueError("bad frame number")
    n = first & (0x7F >> size)
    for b in data[at + 1 : at + size]:
        n = n << 6 | b & 0x3F
    return n, at + size


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values, the best parameter of each row, and the bits that its codes take."""
    z = np.where(residual < 0, -2 * residual - 1, 2 * residual).astype(np.int32)
    mean = z.mean(axis=1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int32), 0, 13)
    best_k, best = guess, None
    for k in (guess, np.maximum(guess - 1, 0)):
        cost = (z >> k[:, None]).sum(axis=1, dtype=np.int64) + (1 + k) * z.shape[1]
        if best is None:
            best = cost
        else:
            best_k, best = np.where(cost < best, k, best_k), np.minimum(cost, best)
    return z, best_k, best


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shifts of each row, by Levinson-Durbin over all rows at once."""
    f = x.astype(np.float64)
    r = [np.einsum("ij,ij->i", f[:, : f.shape[1] - lag], f[:, lag:]) for lag in range(LPC_ORDER + 1)]  # sums of whole numbers: exact in any order
    a, error = np.zeros((LPC_ORDER, len(x))), r[0] + 1e-9
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / error
        before = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = before[j] - k * before[i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=0), 1e-6)
    shift = np.clip(LPC_PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -most - 1, most).astype(np.int32), shift.astype(np.int32)


def _block_of(n: int) -> int:
    return BLOCK if n <= BLOCK * MOST_SEEK else LONG_BLOCK


def _pieces(lengths: list[int]):
    """Groups of (payload, first sample, end) that hold BATCH_SAMPLES or so; a long payload is parted between frames."""
    group, total = [], 0
    for i, n in enumerate(lengths):
        step = max(1, BATCH_SAMPLES // _block_of(n)) * _block_of(n)
        for at in range(0, max(n, 1), step):
            size = min(step, n - at)
            if group and total + size > BATCH_SAMPLES:
                yield group
                group, total = [], 0
            group.append((i, at, at + size))
            total += size
    if group:
        yield group


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload's bytes are its samples, 128 being silence."""
    bodies, sizes = [[] for _ in payloads], [[] for _ in payloads]
    for group in _pieces([len(p) for p in payloads]):
        blocks = [_block_of(len(payloads[i])) for i, _, _ in group]
        found = _frames([payloads[i][a:b] for i, a, b in group], [a // block for (_, a, _), block in zip(group, blocks, strict=True)], blocks)
        for (i, _, _), (body, frame_bytes) in zip(group, found, strict=True):
            bodies[i].append(body)
            sizes[i].append(frame_bytes)
    out = []
    for payload, body, own in zip(payloads, bodies, sizes, strict=True):
        frame_bytes, step = np.concatenate(own), _block_of(len(payload))
        low = int(min(frame_bytes, default=0)), int(max(frame_bytes, default=0))
        block = step if len(frame_bytes) > 1 else max(16, len(payload))
        digest = hashlib.md5()
        for a in range(0, len(payload), BATCH_SAMPLES):
            digest.update((np.frombuffer(payload[a : a + BATCH_SAMPLES], dtype=np.uint8) ^ 0x80).tobytes())
        info = block.to_bytes(2, "big") * 2 + low[0].to_bytes(3, "big") + low[1].to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest.digest()
        seek = np.zeros(len(frame_bytes), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        number = np.arange(len(frame_bytes))
        seek["sample"], seek["offset"], seek["n"] = number * step, np.cumsum(frame_bytes) - frame_bytes, np.minimum(step, len(payload) - number * step)
        seek = seek.tobytes()
        out.append(b"".join([b"fLaC\x00\x00\x00\x22", info, bytes([0x83]), len(seek).to_bytes(3, "big"), seek, *body]))
    return out


def _frames(payloads: list[bytes], firsts: list[int], blocks: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """The frames of pieces, each with the number of its first frame and its samples in a frame, and their sizes."""
    lengths, step = np.array([len(p) for p in payloads], dtype=np.int64), np.array(blocks, dtype=np.int64)
    counts = -(-lengths // step)
    of = np.repeat(np.arange(len(payloads)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    number, step = place + np.array(firsts, dtype=np.int64)[of], step[of]
    size = np.minimum(step, lengths[of] - place * step)
    source = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    first = np.cumsum(size) - size
    heads = []
    for n, s in zip(number.tolist(), size.tolist(), strict=True):
        code = {BLOCK: 0b0011, LONG_BLOCK: 0b0101}.get(s, 0b0111)
        own = code == 0b0111
        head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b00000010]) + _frame_number(n) + ((s - 1).to_bytes(2, "big") if own else b"")
        heads.append(head)
    head_sizes = np.array([len(h) + 1 for h in heads], dtype=np.int64)
    body_bits, plans = np.zeros(len(of), dtype=np.int64), []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        x = source[first[rows][:, None] + np.arange(n)].astype(np.int32) - 128
        # the fixed predictor with the least residual, and a linear one; the cheaper of both, plain samples and silence
        residuals = [x, np.diff(x, axis=1)]
        residuals.append(np.diff(residuals[1], axis=1))
        order = np.argmin([np.abs(r).sum(axis=1) + 4 * o for o, r in enumerate(residuals)], axis=0)
        fixed, cost_fixed = {}, np.zeros(len(rows), dtype=np.int64)
        for o in np.unique(order).tolist():
            m = np.flatnonzero(order == o)
            z, k, cost = _rice(residuals[o][m])
            fixed[o], cost_fixed[m] = (m, z, k), 8 + 8 * o + 10 + cost
        coefficients, shift = _lpc(x)
        predicted = coefficients[0][:, None] * x[:, LPC_ORDER - 1 : n - 1]
        for j in range(1, LPC_ORDER):
            predicted += coefficients[j][:, None] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
        predicted >>= shift[:, None]
        z_lpc, k_lpc, cost = _rice(x[:, LPC_ORDER:] - predicted)
        options = np.array([np.full(len(rows), 8 + 8 * n), np.where((x == x[:, :1]).all(axis=1), 16, 1 << 40), cost_fixed, 8 + 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER + 10 + cost])
        choice = options.argmin(axis=0)
        body_bits[rows] = options[choice, np.arange(len(rows))]
        for c in np.unique(choice[choice < 2]):
            plans.append((rows[choice == c], x[choice == c], int(c), None))
        for o, (m, z, k) in fixed.items():
            own = choice[m] == 2
            if own.any():
                plans.append((rows[m[own]], x[m[own]], 2, (z[own], k[own], o, None, None)))
        if (m := choice == 3).any():
            plans.append((rows[m], x[m], 3, (z_lpc[m], k_lpc[m], LPC_ORDER, coefficients[:, m], shift[m])))
    frame_bytes = head_sizes + -(-body_bits // 8) + 2
    starts = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, dtype=np.uint8)
    for rows, x, kind, plan in plans:
        at = (starts[rows] + head_sizes[rows]) * 8
        full = np.zeros(len(rows), dtype=np.int64)
        if kind == 0:
            _put(bits, at, full + 0b00000010, 8)
            bits[(at + 8)[:, None] + np.arange(8 * x.shape[1])] = np.unpackbits((x & 0xFF).astype(np.uint8), axis=1)
            continue
        if kind == 1:
            _put(bits, at + 8, x[:, 0] & 0xFF, 8)
            continue
        z, k, order, coefficients, shift = plan
        _put(bits, at, full + (0b00010000 | order << 1 if coefficients is None else 0b01000000 | (order - 1) << 1), 8)
        at = at + 8
        for j in range(order):
            _put(bits, at, x[:, j] & 0xFF, 8)
            at = at + 8
        if coefficients is not None:
            _put(bits, at, full + LPC_PRECISION - 1, 4)
            _put(bits, at + 4, shift, 5)
            at = at + 9
            for j in range(order):
                _put(bits, at, coefficients[j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
                at = at + LPC_PRECISION
        _put(bits, at + 6, k, 4)
        at = at + 10
        quotient = z >> k[:, None]
        taken = quotient + (1 + k[:, None])
        stop = (at[:, None] + np.cumsum(taken, axis=1, dtype=np.int64)) - (1 + k[:, None])
        bits[stop] = 1
        for j in range(1, int(k.max()) + 1):
            m = k >= j
            bits[stop[m] + j] = (z[m] >> (k[m] - j)[:, None]) & 1
    data = np.packbits(bits)
    for s, h in zip(starts.tolist(), heads, strict=True):
        data[s : s + len(h)] = np.frombuffer(h, dtype=np.uint8)
    data[starts + head_sizes - 1] = _crc_many(data, starts, head_sizes - 1, 8).astype(np.uint8)
    check = _crc_many(data, starts, frame_bytes - 2, 16)
    data[starts + frame_bytes - 2], data[starts + frame_bytes - 1] = (check >> 8).astype(np.uint8), (check & 0xFF).astype(np.uint8)
    out, done = [], 0
    for n in counts.tolist():
        own = slice(done, done + n)
        done += n
        base = int(starts[own.start]) if n else 0
        out.append((data[base : base + int(frame_bytes[own].sum())].tobytes(), frame_bytes[own]))
    return out


class Stream:
    """The metadata of a FLAC stream and where its frames are."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek, info = 4, False, None, None
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if len(block) < size:
                raise ValueError("metadata is cut off")
            if kind == 0:
                info = block
            elif kind == 3:
                self.seek = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            at += 4 + size
        if info is None:
            raise ValueError("no stream information")
        packed = int.from_bytes(info[10:18], "big")
        self.channels, self.sample_bits, self.total, self.md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34]
        self.block = int.from_bytes(info[:2], "big")
        if self.channels != 1 or self.sample_bits != 8:
            raise ValueError("only 8-bit mono is read")
        self.data, self.frames_at = data, at
        self.seekable = self.seek is not None and int(self.seek["n"].sum()) == self.total
        self.starts = (self.seek["offset"].astype(np.int64) + at) if self.seekable else self._scan()

    def _scan(self) -> np.ndarray:
        """Frame starts of a stream without a full seek table: sync codes whose headers and frames check."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        codes = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8))
        found, ends = [], [*codes[codes > self.frames_at].tolist(), len(raw)]
        start = self.frames_at
        while start < len(raw):
            found.append(start)
            start = next((e for e in ends if e > start + 5 and int.from_bytes(self.data[e - 2 : e], "big") == int(_crc_many(raw, np.array([start]), np.array([e - 2 - start]), 16)[0])), None)
            if start is None:
                raise ValueError("a frame's checksum is wrong")
        return np.array(found, dtype=np.int64)


def _decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, blocks: np.ndarray) -> list[np.ndarray]:
    """Samples of frames of 8-bit mono. numbers: the frame numbers that are expected; blocks: their streams' block sizes."""
    if not len(starts):
        return []
    raw = data.tobytes()
    check = _crc_many(data, starts, sizes - 2, 16)
    if (check != (data[starts + sizes - 2].astype(np.uint32) << 8 | data[starts + sizes - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    bodies, counts = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    for i, s in enumerate(starts.tolist()):
        if raw[s] != 0xFF or raw[s + 1] & 0xFE != 0xF8:
            raise ValueError("no frame where one should be")
        number, at = _read_number(raw, s + 4)
        code = raw[s + 2] >> 4
        if code == 6:
            n, at = raw[at] + 1, at + 1
        elif code == 7:
            n, at = int.from_bytes(raw[at : at + 2], "big") + 1, at + 2
        else:
            n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
        rate = raw[s + 2] & 15
        at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if number != int(numbers[i]) * (int(blocks[i]) if raw[s + 1] & 1 else 1) or not n:
            raise ValueError("a frame is out of order")
        bodies[i], counts[i] = at, n
    if (_crc_many(data, starts, bodies - starts, 8) != data[bodies]).any():
        raise ValueError("a frame header's checksum is wrong")
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]

    def take(at: np.ndarray, width) -> np.ndarray:
        """Up to 24 bits of each."""
        width = np.asarray(width)
        got = (words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        return (got >> (32 - width).astype(np.uint64)).astype(np.int64)

    def signed(v, width):
        width = np.asarray(width)
        return v - ((v >> (width - 1)) & 1) * (np.int64(1) << width)

    at = (bodies + 1) * 8
    kinds = take(at, 8)
    if (kinds & 0x81).any():
        raise ValueError("subframes with wasted bits are not read")
    kinds, at = kinds >> 1, at + 8
    out: list = [None] * len(starts)
    ones = np.flatnonzero(np.unpackbits(data))  # where codes may stop
    for n in np.unique(counts):
        for kind in np.unique(kinds[counts == n]):
            rows = np.flatnonzero((counts == n) & (kinds == kind))
            n, kind, pos = int(n), int(kind), at[rows]
            if kind == 0:
                samples = np.repeat(signed(take(pos, 8), 8)[None], n, axis=0)
            elif kind == 1:
                samples = signed(data[(pos >> 3)[:, None] + np.arange(n)].astype(np.int64).T, 8)
            else:
                order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
                if order < 0 or order > n:
                    raise ValueError("an unknown kind of subframe")
                samples = np.zeros((n, len(rows)), dtype=np.int64)
                for j in range(order):
                    samples[j] = signed(take(pos, 8), 8)
                    pos = pos + 8
                if kind >= 32:
                    precision, shift = take(pos, 4) + 1, signed(take(pos + 4, 5), 5)
                    pos, factors = pos + 9, []
                    for j in range(order):
                        factors.append(signed(take(pos, precision), precision))
                        pos = pos + precision
                if (take(pos, 2) > 1).any():
                    raise ValueError("an unknown residual coding")
                wide, parts = take(pos, 2) + 4, np.int64(1) << take(pos + 2, 4)
                pos, k, raw_bits = pos + 6, None, np.zeros(len(rows), dtype=np.int64)
                where, escaped = None, False
                # samples at which some frame begins a partition, and reads its parameter
                begins = {order, *(t for q in np.unique(parts).tolist() for t in range(0, n, n // q) if t > order)}
                for t in range(order, n):
                    if t in begins:
                        fresh = (t % (n // parts) == 0) | (t == order)
                        read = take(pos, wide)
                        escape = fresh & (read == (np.int64(1) << wide) - 1)
                        k = np.where(fresh, read, 0 if k is None else k)
                        pos = pos + np.where(fresh, wide, 0)
                        raw_bits = np.where(fresh, np.where(escape, take(pos, 5), -1), raw_bits)
                        pos = pos + np.where(escape, 5, 0)
                        where = np.searchsorted(ones, pos)
                        escaped = bool((raw_bits >= 0).any())
                        shift_k = (32 - k).astype(np.uint64)
                    stop = ones[np.minimum(where, len(ones) - 1)]
                    after = stop + 1
                    low = (((words[after >> 3].astype(np.uint64) << (after & 7).astype(np.uint64)) & _U32) >> shift_k).astype(np.int64)
                    z = (stop - pos) << k | low
                    after = after + k
                    value = (z >> 1) ^ -(z & 1)
                    if escaped:
                        own = raw_bits >= 0
                        value = np.where(own, np.where(raw_bits > 0, signed(take(pos, np.maximum(raw_bits, 1)), np.maximum(raw_bits, 1)), 0), value)
                        after = np.where(own, pos + raw_bits, after)
                        where = np.searchsorted(ones, after)
                    else:
                        where = where + 1 + _ones_in(low)
                    samples[t] = value
                    pos = after
                if kind < 32:
                    # fixed predictors are repeated sums of what is left over
                    for step in range(order):
                        below = order - 1 - step
                        anchor = np.diff(samples[:order], n=below, axis=0)[-1]
                        samples[order:] = anchor + np.cumsum(samples[order:], axis=0)
                else:
                    for t in range(order, n):
                        samples[t] += sum(f * samples[t - 1 - j] for j, f in enumerate(factors)) >> shift
            for j, r in enumerate(rows.tolist()):
                out[r] = samples[:, j]
    return out


_U32 = np.uint64(0xFFFFFFFF)
_POP = np.array([bin(i).count("1") for i in range(1 << 14)], dtype=np.int64)


def _ones_in(v: np.ndarray) -> np.ndarray:
    return _POP[v] if int(v.max()) < 1 << 14 else _POP[v & 0x3FFF] + _POP[v >> 14]


def read_blocks(streams: list[bytes], verify: bool = True):
    """PCM blocks of whole streams, in order: stream, block, first sample, bytes. A damaged stream raises ValueError, for its last block
    at the latest."""
    for i, n, first, sizes, pcm in read_runs(streams, verify):
        at = 0
        for k, size in enumerate(sizes):
            yield i, n + k, first + at, pcm[at : at + size]
            at += size


def read_runs(streams: list[bytes], verify: bool = True):
    """Runs of PCM blocks of whole streams: stream, first block, first sample, the blocks' sizes, bytes of all."""
    heads = [Stream(s) for s in streams]
    digests, total = [hashlib.md5() for _ in heads], [0] * len(heads)
    group: list[tuple[int, int, int]] = []  # stream, first and last frame
    ends = [np.append(h.starts[1:], len(h.data)) for h in heads]
    if any((e - h.starts < 8).any() for h, e in zip(heads, ends, strict=True)):
        raise ValueError("a frame is cut off")

    def decoded():
        parts, at, starts, sizes, numbers, blocks = [], 0, [], [], [], []
        for i, a, b in group:
            h = heads[i]
            parts.append(h.data[int(h.starts[a]) : int(ends[i][b - 1])])
            starts.append(h.starts[a:b] - h.starts[a] + at)
            sizes.append(ends[i][a:b] - h.starts[a:b])
            numbers.append(np.arange(a, b))
            blocks.append(np.full(b - a, h.block))
            at += len(parts[-1])
        frames = iter(_decode_frames(np.frombuffer(b"".join(parts), dtype=np.uint8), *map(np.concatenate, (starts, sizes, numbers, blocks))))
        for i, a, b in group:
            own = list(islice(frames, b - a))
            samples = np.concatenate(own).astype(np.int8)
            digests[i].update(samples.tobytes())
            first, total[i] = total[i], total[i] + len(samples)
            if b == len(heads[i].starts) and (total[i] != heads[i].total or verify and any(heads[i].md5) and digests[i].digest() != heads[i].md5):
                raise ValueError("a stream's samples are not those that were written")
            yield i, a, first, [len(x) for x in own], (samples.view(np.uint8) ^ 0x80).tobytes()

    held = 0
    for i, h in enumerate(heads):
        if not len(h.starts) and h.total:
            raise ValueError("a stream's samples are not those that were written")
        step = max(1, BATCH_SAMPLES // max(1, h.block))
        for a in range(0, len(h.starts), step):
            b = min(a + step, len(h.starts))
            if group and held + (b - a) * h.block > BATCH_SAMPLES:
                yield from decoded()
                group, held = [], 0
            group.append((i, a, b))
            held += (b - a) * h.block
    if group:
        yield from decoded()


def decode_many(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """Payloads of whole streams."""
    out: list[list[bytes]] = [[] for _ in streams]
    for i, _, _, _, pcm in read_runs(streams, verify):
        out[i].append(pcm)
    return [b"".join(x) for x in out]


def decode(stream: bytes) -> bytes:
    return decode_many([stream])[0]


def seek_many(streams: list[bytes], firsts: list[int], count: int) -> list[bytes]:
    """count samples of each stream, from a place of its own; only the frames that hold them are read."""
    heads, cuts, parts, at = [Stream(s) for s in streams], [], [], 0
    starts, sizes, numbers, blocks = [], [], [], []
    for h, first in zip(heads, firsts, strict=True):
        first, last = max(0, min(first, h.total)), max(0, min(first + count, h.total))
        if last <= first or not len(h.starts):
            cuts.append((0, 0, 0))
            continue
        ends = np.append(h.starts[1:], len(h.data))
        offsets = h.seek["sample"].astype(np.int64) if h.seekable else np.arange(len(h.starts)) * h.block
        lo, hi = int(np.searchsorted(offsets, first, side="right")) - 1, int(np.searchsorted(offsets, last, side="left"))
        parts.append(h.data[int(h.starts[lo]) : int(ends[hi - 1])])
        starts.append(h.starts[lo:hi] - h.starts[lo] + at)
        sizes.append(ends[lo:hi] - h.starts[lo:hi])
        numbers.append(np.arange(lo, hi))
        blocks.append(np.full(hi - lo, h.block))
        at += len(parts[-1])
        cuts.append((hi - lo, first - int(offsets[lo]), last - int(offsets[lo])))
    if not parts:
        return [b"" for _ in streams]
    frames = _decode_frames(np.frombuffer(b"".join(parts), dtype=np.uint8), *map(np.concatenate, (starts, sizes, numbers, blocks)))
    out, done = [], 0
    for n, first, last in cuts:
        out.append((np.concatenate(frames[done : done + n]) + 128).astype(np.uint8).tobytes()[first:last] if n else b"")
        done += n
    return out


def seek(stream: bytes, first: int, count: int) -> bytes:
    return seek_many([stream], [first], count)[0]


def pad(payload: bytes) -> bytes:
    return payload + b" " * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def _grouped(values, size):
    """Index ranges of about BATCH_SAMPLES."""
    start = total = 0
    for i, v in enumerate(values):
        if i > start and total + size(v) > BATCH_SAMPLES:
            yield start, i
            start, total = i, 0
        total += size(v)
    if len(values) > start:
        yield start, len(values)


def encode_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds media binary: the padded UTF-8 of a text as a FLAC stream, and n_bytes long."""
    keys = [c for c in df.columns if c != text]
    schema = T.StructType([*key_schema(df, keys), T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            raw = [x.encode("utf-8", "surrogatepass") for x in batch.column("__body").to_pylist()]
            for i, j in _grouped(raw, len):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keys), pa.array([len(x) for x in raw[i:j]], type=pa.int64()), pa.array(encode([pad(x) for x in raw[i:j]]), type=pa.binary())], schema=arrow)

    return df.select(*(F.col(f"`{k}`") for k in keys), text_or_empty(f"`{text}`").alias("__body")).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pcm_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each frame of each stream: keys, block int, first_sample long, n_samples int, pcm binary, error string."""
    keys = [c for c in df.columns if c != media]
    schema = T.StructType([*key_schema(df, keys), *T._parse_datatype_string("block int, first_sample long, n_samples int, pcm binary, error string").fields])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(media)
            for i in range(batch.num_rows):
                own, rows, size = [batch.column(k)[i].as_py() for k in keys], [], 0
                try:
                    data = column[i].as_py()
                    if data is None:
                        raise ValueError("no stream")
                    for _ in read_blocks([data]):  # a damaged stream has no blocks, so all of it is checked first
                        pass
                    for _, n, first, pcm in read_blocks([data]):
                        rows.append((*own, n, first, len(pcm), pcm, None))
                        size += len(pcm)
                        if size > BATCH_SAMPLES:
                            yield _batch(rows, arrow)
                            rows, size = [], 0
                except (ValueError, IndexError) as e:
                    rows = [(*own, None, None, None, None, str(e))]
                if rows:
                    yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


class Summary:
    """Of PCM blocks in order: size, digest, and features (peak, zero crossings, energy and sum of samples) as exact integers."""

    def __init__(self):
        self.size, self.sha, self.peak, self.crossings, self.energy, self.sum, self.last = 0, hashlib.sha256(), 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
        below = x < 0
        self.size += len(pcm)
        self.sha.update(pcm)
        self.peak, self.energy, self.sum = max(self.peak, int(np.abs(x).max(initial=0))), self.energy + int((x * x).sum()), self.sum + int(x.sum())
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.last is not None and len(x) > 0 and self.last != below[0])
        self.last = bool(below[-1]) if len(x) else self.last

    def features(self) -> str:
        return f"peak={self.peak} crossings={int(self.crossings)} energy={self.energy} sum={self.sum}"


def features(pcm: bytes) -> str:
    out = Summary()
    out.add(pcm)
    return out.features()


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """What is read back from each stream: keys and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    keys = [c for c in df.columns if c != media]
    schema = T.StructType([*key_schema(df, keys), *T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            streams = batch.column(media).to_pylist()
            for i, j in _grouped(streams, len):
                part = streams[i:j]
                found = [Summary() for _ in part]
                for k, _, _, _, pcm in read_runs(part):
                    found[k].add(pcm)
                tails = seek_many(part, [f.size - 16 for f in found], 16)
                rows = [(f.size, f.sha.hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), f.features()) for s, f, tail in zip(part, found, tails, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keys), *(pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[-6:], strict=True))], schema=arrow)

    return df.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(encode_column(table(spark, sf_dir, "documents").select("doc_id", "text")))
