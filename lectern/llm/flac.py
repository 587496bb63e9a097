"""FLAC columns (operator 2): write and read mono FLAC streams, checking every frame, many frames in step.

Format (RFC 9639): fLaC, STREAMINFO, SEEKTABLE, then frames of one block size. A subframe is constant,
verbatim, a fixed or an adaptive linear predictor with Rice-coded residuals. Both directions work on a
matrix with a row per frame: step t treats sample t of all frames at once, so Python's cost is per
batch and not per sample. Memory is bounded by the batch, which slices() holds to a few MB of text.
Streams are read block by block from the places that their seek table gives. Streams of other encoders (several channels, other depths
and block sizes, escaped or wide residuals) are read sample by sample by read_stream().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_bytes, slices

BLOCK = 192  # samples of a frame: block size code 1 of the format
SEEK_EVERY = 32  # frames from one seek point to the next
CHUNK = 4096  # frames treated at once, whatever the documents' lengths
#: Fixed values of the format: predictors of order 0 to 4 as coefficients of earlier samples.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LPC_PRECISION, LPC_SHIFT = 12, 9
LPC_ORDER = 3  # of the adaptive predictor that each frame tries in production


class FlacError(ValueError):
    """A stream that is not valid."""


class OtherProfile(FlacError):
    """A stream that uses more of the format than the reader in step: read_stream() reads it."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of the given stretches of data. Leading zeros change nothing, so stretches are read aligned to their ends."""
    crc = np.zeros(len(start), np.uint16)
    if not len(start):
        return crc
    longest, end = int(length.max()), start + length
    for t in range(longest, 0, -1):
        at = end - t
        b = np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.uint16)
        crc = CRC8[crc ^ b] if bits == 8 else (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ b]
    return crc


def _coded_numbers(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes) by length: frame numbers in the format's UTF-8 style."""
    out, low = [], 0
    for n, bits in ((1, 7), (2, 11), (3, 16), (4, 21), (5, 26), (6, 31)):
        rows = np.flatnonzero((numbers >= low) & (numbers < 1 << bits))
        low = 1 << bits
        if len(rows):
            v = numbers[rows]
            lead = 0 if n == 1 else (0xFF << (8 - n)) & 0xFF
            cols = [lead | v >> (6 * (n - 1))] + [0x80 | (v >> (6 * i)) & 0x3F for i in range(n - 2, -1, -1)]
            out.append((rows, np.stack(cols, 1).astype(np.uint8)))
    return out


def _lpc(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients of each row by the normal equations of its autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(1) for k in range(order + 1)], 1)
    lag = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
    a = r[:, lag] + np.eye(order) * (r[:, :1, None] * 1e-6 + 1e-3)
    c = np.linalg.solve(a, r[:, 1:, None])[:, :, 0]
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(c * (1 << LPC_SHIFT)), -most, most).astype(np.int64)


def encode(payloads: list[bytes], lpc_order: int = 0) -> list[bytes]:
    """A FLAC stream of 8-bit samples for each payload, whose length is a positive multiple of BLOCK; byte b is sample b - 128.

    Each frame takes the cheapest of a constant, the fixed predictors, with lpc_order an adaptive
    predictor of that order, and verbatim samples.
    """
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError("a payload is a positive multiple of the block size")
    if not payloads:
        return []
    per_doc = np.array([len(p) // BLOCK for p in payloads])
    first = np.concatenate([[0], np.cumsum(per_doc)])
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = np.arange(len(samples)) - np.repeat(first[:-1], per_doc)
    parts = [_encode_frames(samples[i : i + CHUNK].astype(np.int32) - 128, number[i : i + CHUNK], lpc_order) for i in range(0, len(samples), CHUNK)]
    coded, size = b"".join([p[0].tobytes() for p in parts]), np.concatenate([p[1] for p in parts])
    start = np.concatenate([[0], np.cumsum(size)])
    done = []
    for d, payload in enumerate(payloads):
        a, b = first[d], first[d + 1]
        seek = b"".join(struct.pack(">QQH", (f - a) * BLOCK, start[f] - start[a], BLOCK) for f in range(a, b, SEEK_EVERY))
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        sizes = size[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        done.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + coded[start[a] : start[b]])
    return done


def _encode_frames(x: np.ndarray, number: np.ndarray, lpc_order: int) -> tuple[np.ndarray, np.ndarray]:
    """The frames of these rows of samples, one after another, and each one's size in bytes."""
    n = len(x)
    order, best, residual = np.zeros(n, np.int64), None, np.zeros_like(x)
    e, cand = x, []
    for p in range(5):
        if p:
            e = np.diff(e, axis=1)
        cand.append((p, e, None))
    if lpc_order:
        coef = _lpc(x, lpc_order)
        pred = sum(coef[:, j, None] * x[:, lpc_order - 1 - j : BLOCK - 1 - j] for j in range(lpc_order)) >> LPC_SHIFT
        cand.append((lpc_order, (x[:, lpc_order:] - pred).astype(np.int32), coef))
    kinds = np.zeros(n, np.int64)  # index into cand
    ks = np.zeros(n, np.int64)
    for i, (p, e, coef) in enumerate(cand):
        zz = (e << 1) ^ (e >> 31)
        mean = zz.mean(1)
        k0 = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 13).astype(np.int32)
        fit = [(zz >> (k0 + d)[:, None]).sum(1) + (BLOCK - p) * (1 + k0 + d) for d in (0, 1)] if i in (0, 1) or coef is not None or best is None or (mean < best_mean).any() else None
        if fit is None:
            continue
        k = np.where(fit[1] < fit[0], k0 + 1, k0)
        cost = np.minimum(fit[0], fit[1]) + 8 * p + 18 + (9 + LPC_PRECISION * p if coef is not None else 0)
        most = (zz >> k[:, None]).max(1)
        cost = np.where(most > 40, 1 << 30, cost)
        if best is None:
            best, best_mean = np.full(n, 8 * BLOCK + 8), np.full(n, np.inf)
            kinds[:] = -1
        better = cost < best
        best, best_mean = np.where(better, cost, best), np.where(better, mean, np.minimum(best_mean, mean))
        kinds[better], ks[better], order[better] = i, k[better], p
        if better.any():
            residual[better, p:] = zz[better]
    same = (x == x[:, :1]).all(1)
    kinds[same], best[same] = -2, 16

    head = np.zeros(n, np.int64)
    coded = _coded_numbers(number)
    for rows, b in coded:
        head[rows] = 4 + b.shape[1] + 1
    body = (best + 7) // 8
    size = head + body + 2
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), np.uint8)
    s = start[:-1]
    for i, v in enumerate((0xFF, 0xF8, 0x10, 0x02)):  # sync, fixed block size; 192 samples; mono, 8 bits
        out[s + i] = v
    for rows, b in coded:
        for j in range(b.shape[1]):
            out[s[rows] + 4 + j] = b[:, j]
    out[s + head - 1] = _crcs(out, s, head - 1, 8).astype(np.uint8)

    bit = (s + head) * 8
    writes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # values, widths (to 16), bit places
    add = lambda v, w, at: writes.append((np.asarray(v, np.int64), np.broadcast_to(np.asarray(w, np.int64), np.shape(v)), np.asarray(at, np.int64)))
    const, verb = np.flatnonzero(kinds == -2), np.flatnonzero(kinds == -1)
    add(np.zeros(len(const)), 8, bit[const])
    add(x[const, 0] & 0xFF, 8, bit[const] + 8)
    add(np.full(len(verb), 1 << 1), 8, bit[verb])
    for rows in (verb,):
        if len(rows):
            at = s[rows] + head[rows] + 1
            out[at[:, None] + np.arange(BLOCK)] = (x[rows] & 0xFF).astype(np.uint8)
    for i, (p, _, coef) in enumerate(cand):
        rows = np.flatnonzero(kinds == i)
        if not len(rows):
            continue
        at = bit[rows]
        add(np.full(len(rows), ((8 + p) if coef is None else (32 + p - 1)) << 1), 8, at)
        at = at + 8
        for j in range(p):
            add(x[rows, j] & 0xFF, 8, at)
            at = at + 8
        if coef is not None:
            add(np.full(len(rows), (LPC_PRECISION - 1) << 5 | LPC_SHIFT), 9, at)
            at = at + 9
            for j in range(p):
                add(coef[rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION, at)
                at = at + LPC_PRECISION
        k = ks[rows]
        add(k, 10, at)  # method 0, partition order 0, then the parameter of 4 bits
        at = at + 10
        zz = residual[rows, p:].astype(np.int64)
        q = zz >> k[:, None]
        width = q + 1 + k[:, None]
        end = np.cumsum(width, 1)
        last = at[:, None] + end
        tail = np.broadcast_to(k[:, None], zz.shape)
        add(((1 << tail) | (zz & ((1 << tail) - 1))).ravel(), (tail + 1).ravel(), (last - tail - 1).ravel())
    value, width, place = (np.concatenate([w[i] for w in writes]) for i in range(3))
    window = value << (24 - width - (place & 7))
    byte = place >> 3
    flat = np.zeros(len(out) + 3)
    for i in range(3):
        part = (window >> (16 - 8 * i)) & 0xFF
        flat += np.bincount(byte + i, weights=part, minlength=len(flat))[: len(flat)]
    out |= flat[: len(out)].astype(np.uint8)
    crc = _crcs(out, s, size - 2, 16)
    out[s + size - 2], out[s + size - 1] = (crc >> 8).astype(np.uint8), (crc & 0xFF).astype(np.uint8)
    return out, size


@dataclass
class Head:
    """What stands before the frames: STREAMINFO, the byte place of the first frame, and seek points (sample, bytes after the first frame's place)."""

    min_block: int
    max_block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    start: int
    points: list[tuple[int, int]]

    @property
    def own(self) -> bool:
        """Whether it is of the profile that encode() writes."""
        return self.min_block == self.max_block == BLOCK and self.channels == 1 and self.bits == 8 and self.samples > 0 and self.samples % BLOCK == 0


def metadata(media: bytes) -> Head:
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, info, points = 4, None, []
    while True:
        if at + 4 > len(media):
            raise FlacError("cut off in its metadata")
        kind, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [struct.unpack_from(">QQ", body, i) for i in range(0, n - n % 18, 18)]
        at += 4 + n
        if kind & 0x80:
            break
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    rest = int.from_bytes(info[10:18], "big")
    points = [p for p in points if p[0] != (1 << 64) - 1]  # places kept free
    return Head(int.from_bytes(info[:2], "big"), int.from_bytes(info[2:4], "big"), rest >> 44, (rest >> 41 & 7) + 1, (rest >> 36 & 31) + 1, rest & ((1 << 36) - 1), info[18:34], at, points)


def seek_ranges(media: bytes, head: Head) -> list[tuple[int, int, int, int]]:
    """(first sample, end sample, first byte, end byte) from each seek point to the next; the whole stream where there is none at its begin."""
    points = sorted({p for p in head.points if p[0] < head.samples})
    if not points or points[0] != (0, 0) or any(p[0] % BLOCK for p in points):
        points = [(0, 0)]
    ends = [*points[1:], (head.samples, len(media) - head.start)]
    return [(a[0], b[0], head.start + a[1], head.start + b[1]) for a, b in zip(points, ends, strict=True)]


def _frames(media: bytes, first: int, count: int, at: int, end: int) -> np.ndarray:
    """Starts of count frames from number first on between two places, and the end: sync codes with a valid header checksum and the number that is due."""
    if end > len(media) or end - at < 7:
        raise FlacError("a seek point leads out of the stream")
    data = np.frombuffer(media, np.uint8, end - at, at)
    hits = np.flatnonzero((data[:-6] == 0xFF) & (data[1:-5] == 0xF8) & (data[2:-4] == 0x10) & (data[3:-3] == 0x02))
    lead = data[hits + 4].astype(np.int64)
    n = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    fits = hits + 5 + n <= len(data)
    hits, lead, n = hits[fits], lead[fits], n[fits]
    number = np.where(n == 1, lead, lead & ((1 << np.maximum(7 - n, 0)) - 1))
    for j in range(1, 6):
        number = np.where(j < n, number << 6 | data[np.minimum(hits + 4 + j, len(data) - 1)] & 0x3F, number)
    good = _crcs(data, hits, 4 + n, 8) == data[hits + 4 + n]
    hits, number = hits[good], number[good]
    if len(number) != count or (number != np.arange(first, first + count)).any():
        due, keep = first, []
        for h, v in zip(hits.tolist(), number.tolist(), strict=True):
            if v == due and due < first + count:
                keep.append(h)
                due += 1
        hits = np.array(keep, np.int64)
        if due != first + count:
            raise OtherProfile(f"{due - first} of {count} frames found")
    return np.append(hits, len(data)) + at


def _in_step(media: list[bytes], ranges: list[list[tuple[int, int, int, int]]]) -> list[list[tuple[int, bytes]]]:
    """(first sample, payload bytes) of the given ranges of each stream, all frames treated together."""
    starts, ends, base = [], [], 0
    for m, of in zip(media, ranges, strict=True):
        for first, end, at, stop in of:
            f = _frames(m, first // BLOCK, (end - first) // BLOCK, at, stop) + base
            starts.append(f[:-1])
            ends.append(f[1:])
        base += len(m)
    s, e = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (starts, ends))
    if not len(s):
        return [[] for _ in media]
    data = np.frombuffer(b"".join(media) + bytes(16), np.uint8)
    out = np.concatenate([_decode_frames(data[s[i] : e[min(i + CHUNK, len(s)) - 1] + 16], s[i : i + CHUNK] - s[i], e[i : i + CHUNK] - s[i]) for i in range(0, len(s), CHUNK)])
    done, row = [], 0
    for of in ranges:
        blocks = []
        for first, end, _, _ in of:
            n = (end - first) // BLOCK
            blocks.append((first, out[row : row + n].tobytes()))
            row += n
        done.append(blocks)
    return done


def _bytes_of(media: bytes) -> bytes:
    """The payload of a stream of another profile with one channel of 8 bits."""
    channels, _, bits = read_stream(media)
    if len(channels) != 1 or bits != 8:
        raise FlacError("the samples are not one byte each: use read_stream")
    return (channels[0] + 128).astype(np.uint8).tobytes()


def decode_blocks(media: list[bytes], verify_md5: bool = True) -> list[list[tuple[int, bytes]]]:
    """(sample offset, payload bytes) of each stream's blocks, each read from its own seek point on.

    Frame checksums, and the whole's MD5, are verified; FlacError if one is wrong.
    """
    heads = [metadata(m) for m in media]
    try:
        if not all(h.own for h in heads):
            raise OtherProfile("another block size, depth or number of channels")
        done = _in_step(media, [seek_ranges(m, h) for m, h in zip(media, heads, strict=True)])
    except OtherProfile:
        if len(media) > 1:
            return [decode_blocks([m], verify_md5)[0] for m in media]
        return [[(0, _bytes_of(media[0]))]]
    for blocks, h in zip(done, heads, strict=True):
        if verify_md5 and hashlib.md5((np.frombuffer(b"".join([p for _, p in blocks]), np.uint8) ^ 0x80).tobytes()).digest() != h.md5:
            raise FlacError("the samples' MD5 is wrong")
    return done


def decode(media: list[bytes], verify_md5: bool = True) -> list[bytes]:
    """The payloads of streams with one channel of 8 bits."""
    return [b"".join([p for _, p in blocks]) for blocks in decode_blocks(media, verify_md5)]


def samples_at(media: bytes, first: int, n: int) -> bytes:
    """n payload bytes from sample first on, reading no more than the seek ranges that hold them."""
    head = metadata(media)
    if not head.own:
        return _bytes_of(media)[first : first + n]
    ranges = [r for r in seek_ranges(media, head) if r[0] < first + n and r[1] > first]
    blocks = _in_step([media], [ranges])[0]
    return b"".join([p for _, p in blocks])[first - blocks[0][0] :][:n] if blocks else b""


class _Bits:
    """Big-endian bits of a stretch of bytes."""

    def __init__(self, data: bytes, at: int):
        self.data, self.bit = data, 8 * at

    def take(self, n: int) -> int:
        if self.bit + n > 8 * len(self.data):
            raise FlacError("cut off in a frame")
        at, end = self.bit >> 3, (self.bit + n + 7) >> 3
        v = int.from_bytes(self.data[at:end], "big") >> (8 * end - self.bit - n) & ((1 << n) - 1)
        self.bit += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: _Bits, order: int, block: int) -> list[int]:
    wide = {0: 4, 1: 5}.get(bits.take(2))
    if wide is None:
        raise FlacError("a reserved residual coding")
    parts = 1 << bits.take(4)
    if block % parts or block // parts < order:
        raise FlacError("a partition order does not fit")
    out: list[int] = []
    for i in range(parts):
        k, n = bits.take(wide), block // parts - (order if not i else 0)
        if k == (1 << wide) - 1:
            depth = bits.take(5)
            out += [bits.signed(depth) for _ in range(n)]
        else:
            for _ in range(n):
                zz = bits.zeros() << k | bits.take(k)
                out.append(zz >> 1 ^ -(zz & 1))
    return out


def _subframe(bits: _Bits, depth: int, block: int) -> np.ndarray:
    if bits.take(1):
        raise FlacError("no subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * block
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        coef, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("a reserved precision or shift")
            coef = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, order, block):
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise FlacError("a reserved subframe type")
    return np.array(x, np.int64) << wasted


def read_stream(media: bytes) -> tuple[list[np.ndarray], int, int]:
    """Samples of each channel, rate and depth of any stream of the format, frame by frame. FlacError if a checksum is wrong or it is cut off."""
    head = metadata(media)
    at, blocks, data = head.start, [], np.frombuffer(media, np.uint8)
    crc = lambda a, b, n: int(_crcs(data, np.array([a]), np.array([b - a]), n)[0])
    while at < len(media) and (not head.samples or sum(len(b[0]) for b in blocks) < head.samples):
        bits = _Bits(media, at)
        if bits.take(15) != 0x7FFC:
            raise FlacError("no frame where one is due")
        bits.take(1)  # blocking strategy: numbers of frames or of samples
        size, rate, assigned, depth = bits.take(4), bits.take(4), bits.take(4), {0: head.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(bits.take(3))
        if bits.take(1) or assigned > 10 or depth is None or not size:
            raise FlacError("a reserved value in a frame's header")
        lead = bits.take(8)
        bits.take(8 * (0 if lead < 0x80 else next(n for n in range(1, 8) if not lead & (0x40 >> n) or n == 7)))
        block = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if crc(at, bits.bit >> 3, 8) != bits.take(8):
            raise FlacError("a frame header's checksum is wrong")
        side = {8: 1, 9: 0, 10: 1}.get(assigned)
        x = [_subframe(bits, depth + (c == side), block) for c in range(2 if assigned > 7 else assigned + 1)]
        if assigned == 8:
            x[1] = x[0] - x[1]
        elif assigned == 9:
            x[0] = x[0] + x[1]
        elif assigned == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        end = (bits.bit + 7) >> 3
        if end + 2 > len(media) or crc(at, end, 16) != int.from_bytes(media[end : end + 2], "big"):
            raise FlacError("a frame's checksum is wrong")
        blocks.append(x)
        at = end + 2
    channels = [np.concatenate([b[c] for b in blocks]) if blocks else np.zeros(0, np.int64) for c in range(head.channels)]
    if head.samples and len(channels[0]) != head.samples:
        raise FlacError("the stream has other samples than it states")
    width = (head.bits + 7) // 8
    raw = np.stack(channels, 1).astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes() if blocks else b""
    if any(head.md5) and hashlib.md5(raw).digest() != head.md5:
        raise FlacError("the samples' MD5 is wrong")
    return channels, head.rate, head.bits


def _decode_frames(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Payload bytes, a row a frame, of the frames from s to e. 16 bytes that do not matter follow the last."""
    if (_crcs(data, s, e - s - 2, 16) != (data[e - 2].astype(np.uint16) << 8 | data[e - 1])).any():
        raise FlacError("a frame's checksum is wrong")
    lead = data[s + 4]
    n = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    sub = s + 5 + n
    kind = data[sub] >> 1
    x = np.zeros((len(s), BLOCK), np.int32)
    rows = np.flatnonzero(kind == 0)
    x[rows] = data[sub[rows] + 1].view(np.int8).astype(np.int32)[:, None]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        x[rows] = data[(sub[rows] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise FlacError("a reserved subframe type")
    wide = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        wide = wide << np.uint64(8) | data[i : len(data) - 7 + i]
    for k in np.unique(kind[kind > 1]).tolist():
        rows = np.flatnonzero(kind == k)
        x[rows] = _predicted(wide, sub[rows] * 8 + 8, k)
    return (x + 128).astype(np.uint8)


def _predicted(wide: np.ndarray, bit: np.ndarray, kind: int) -> np.ndarray:
    """Samples of frames of one predictor. wide: the 8 bytes from each byte on; bit: where the subframes' contents begin."""
    order = kind - 8 if kind < 32 else kind - 31
    x = np.zeros((BLOCK, len(bit)), np.int64)

    def peek(width):
        return ((wide[bit >> 3] << (bit & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    for j in range(order):
        v = peek(8)
        x[j] = v - ((v & 0x80) << 1)
        bit = bit + 8
    if kind < 32:
        coef, shift = [np.int64(c) for c in FIXED[order]], np.int64(0)
    else:
        v = peek(9)
        precision, shift = int(v[0] >> 5) + 1, v & 31
        if (v & 16).any() or precision == 16:
            raise FlacError("a reserved precision or shift")
        if ((v >> 5) + 1 != precision).any():
            raise OtherProfile("frames of one order differ in precision")
        bit, coef = bit + 9, []
        for _ in range(order):
            v = peek(precision)
            coef.append(v - ((v >> (precision - 1)) << precision))
            bit = bit + precision
    v = peek(6)
    bit = bit + 6
    if (v >> 4).any():
        raise OtherProfile("residuals with parameters of 5 bits")
    parts = np.int64(1) << (v & 15)
    each = BLOCK // parts
    if (each * parts != BLOCK).any() or (each < order).any():
        raise FlacError("a partition order does not fit")
    k = np.zeros(len(bit), np.int64)
    for t in range(order, BLOCK):
        due = np.flatnonzero((t % each == 0) | (t == order)) if t == order or (parts > 1).any() else ()
        if len(due):
            b = bit[due]
            k[due] = ((wide[b >> 3] << (b & 7).astype(np.uint64)) >> np.uint64(60)).astype(np.int64)
            bit[due] = b + 4
            if (k[due] == 15).any():
                raise OtherProfile("an escaped partition")
        w = wide[bit >> 3] << (bit & 7).astype(np.uint64)  # the top 57 bits are valid
        lead = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if int(lead.max()) + int(k.max()) > 55:
            q, more, at = np.zeros(len(bit), np.int64), np.ones(len(bit), bool), bit.copy()
            while more.any():  # a run of zeros over the window's end
                w = wide[at >> 3] << (at & 7).astype(np.uint64)
                step = np.minimum(53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64), 32)
                q, at = q + np.where(more, step, 0), at + np.where(more, step, 0)
                more &= step == 32
            lead, w = q, wide[at >> 3] << (at & 7).astype(np.uint64)
            low = ((w << np.uint64(1)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        else:
            low = ((w << (lead + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        zz = lead << k | low
        bit = bit + lead + 1 + k
        r = (zz >> 1) ^ -(zz & 1)
        if order:
            pred = coef[0] * x[t - 1]
            for j in range(1, order):
                pred = pred + coef[j] * x[t - 1 - j]
            r = r + (pred >> shift)
        x[t] = r
    return x.T.astype(np.int32)


def padded(raw: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of BLOCK."""
    return raw + b" " * ((-len(raw)) % BLOCK or (BLOCK if not raw else 0))


def store_flac(docs: DataFrame, lpc_order: int = LPC_ORDER) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded, as a FLAC stream.

    Null and empty texts are 192 spaces; repeated rows come repeatedly; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                raw = arrow_bytes(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode([padded(x) for x in raw], lpc_order), pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples_per_block: int = 10 * SEEK_EVERY * BLOCK) -> DataFrame:
    """Decode media into PCM blocks: doc_id, block, sample_offset (seek here), n_samples, pcm (unsigned 8-bit).

    By default a block begins at each tenth seek point. A null or broken stream fails with FlacError: nothing is passed over.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 2 << 20):
                rows = []
                for d, blocks in zip(b.column("doc_id").to_pylist(), decode_blocks([m or b"" for m in b.column("media").to_pylist()]), strict=True):
                    p = b"".join([x for _, x in blocks])
                    rows += [(d, i // samples_per_block, i, len(p[i : i + samples_per_block]), p[i : i + samples_per_block]) for i in range(0, len(p), samples_per_block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples long, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Read each stream back, block by block from its seek points, and describe it: the decoded payload's size and checksums, the stored form's, and a feature string."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 2 << 20):
                media = b.column("media").to_pylist()
                cols: list[list] = [[] for _ in range(6)]
                for m, blocks in zip(media, decode_blocks(media), strict=True):
                    p = b"".join([x for _, x in blocks])
                    v = np.frombuffer(p, np.uint8).astype(np.int64) - 128
                    cross = int(np.count_nonzero(np.diff(v < np.int64(v.mean()))))
                    feature = f"frames={len(p) // BLOCK};blocks={len(blocks)};peak={int(np.abs(v).max())};energy={int((v * v).sum())};crossings={cross}"
                    for to, y in zip(cols, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                        to.append(y)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, schema.types[2:], strict=True))], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
