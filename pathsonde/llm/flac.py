"""FLAC streams of 8-bit mono samples: encoding, decoding with checks, and seekable PCM blocks.

Frames are handled many at a time. In a Rice-coded residual each code's end gives the next one's
start, so the codes of all frames are walked in step; remainders, predictors and checksums follow as
array operations. Streams that use more of the format than the encoder does (partitions, escapes, no
seek table) are decoded frame by frame.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, RATE, ORDER, PRECISION = 4096, 8000, 4, 12
#: Frames that are worked on together.
FRAMES = 384


class BadStream(ValueError):
    """A stream that breaks the format or one of its checksums."""


@functools.lru_cache(maxsize=1)
def crc_tables() -> tuple[list[int], np.ndarray, np.ndarray]:
    """CRC-8 (07) by byte, CRC-16 (8005) by byte, and what a byte adds to a CRC-16 from each distance to the end."""
    eight, sixteen = [], np.zeros(256, dtype=np.uint16)
    for b in range(256):
        c, d = b, b << 8
        for _ in range(8):
            c = (c << 1 ^ (7 if c & 128 else 0)) & 255
            d = (d << 1 ^ (0x8005 if d & 32768 else 0)) & 65535
        eight.append(c)
        sixteen[b] = d
    far = np.zeros((BLOCK + 256, 256), dtype=np.uint16)
    far[0] = sixteen
    for k in range(1, len(far)):
        far[k] = (far[k - 1] << 8) ^ sixteen[far[k - 1] >> 8]
    return eight, sixteen, far.ravel()


def crc8(data: bytes) -> int:
    c, table = 0, crc_tables()[0]
    for b in data:
        c = table[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c, table = 0, crc_tables()[1]
    for b in data:
        c = (c << 8 & 65535) ^ int(table[c >> 8 ^ b])
    return c


def crc16_each(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of bytes; the runs follow each other in ``data``."""
    if sizes.max() > BLOCK + 256:
        return np.array([crc16(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)], dtype=np.uint16)
    distance = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(data))
    return np.bitwise_xor.reduceat(crc_tables()[2][distance * 256 + data], starts)


def coded_number(n: int) -> bytes:
    """A frame number in the UTF-8 scheme, which goes on to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)) or not tail:
        tail.append(128 | n & 63)
        n >>= 6
    lead = (0xFF00 >> (len(tail) + 1)) & 255
    return bytes([lead | n, *reversed(tail)])


def frame_header(number: int, size: int) -> bytes:
    full = size == BLOCK
    head = bytes([0xFF, 0xF8, (0xC0 if full else 0x70) | 4, 0x02]) + coded_number(number) + (b"" if full else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _best_rice(u: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter and bits for each frame; only parameters next to the mean's are tried."""
    sums = np.add.reduceat(u, starts, dtype=np.int64)
    guess = np.maximum(0, np.frexp(sums / np.maximum(counts, 1))[1] - 1)
    best, bits = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), 1 << 60)
    for step in (-1, 0):
        k = np.clip(guess + step, 0, 14)
        cost = np.add.reduceat(u >> np.repeat(k, counts).astype(np.int32), starts, dtype=np.int64) + counts * (k + 1)
        better = cost < bits
        best, bits = np.where(better, k, best), np.where(better, cost, bits)
    return best, bits


def _lpc(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each frame, and whether they can be used."""
    wide = x.astype(np.int64)
    r = np.zeros((ORDER + 1, len(starts)))
    for j in range(ORDER + 1):
        product = wide.copy()
        product[j:] *= wide[: len(wide) - j]
        product[inside < j] = 0
        r[j] = np.add.reduceat(product, starts)
    a, err, ok = np.zeros((ORDER, len(starts))), r[0].copy(), (r[0] > 0) & (sizes > 2 * ORDER)
    for i in range(ORDER):
        acc = r[i + 1].copy()
        for j in range(i):
            acc -= a[j] * r[i - j]
        k = acc / np.where(err > 0, err, 1)
        old = a[:i].copy()
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        a[i] = k
        err *= 1 - k * k
        ok &= err > 0
    a[:, ~ok] = 0
    top = np.abs(a).max(axis=0)
    shift = np.clip(PRECISION - 1 - np.frexp(np.where(top > 0, top, 1))[1], 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * 2.0**shift), -limit, limit).astype(np.int32), shift.astype(np.int32), ok


def _encode_frames(samples: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    sizes = np.array([len(s) for s in samples])
    x = np.concatenate(samples).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.arange(len(x)) - np.repeat(starts, sizes)
    flat = (np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts))

    first = np.diff(x, prepend=0)
    coefficients, shifts, usable = _lpc(x, starts, sizes, inside)
    guess = np.zeros(len(x), dtype=np.int32)
    for j in range(ORDER):
        guess[j + 1 :] += np.repeat(coefficients[j], sizes)[j + 1 :] * x[: len(x) - j - 1]
    linear = x - (guess >> np.repeat(shifts, sizes))
    residuals = {}
    for order, r in ((1, first), (ORDER, linear)):
        u = _zigzag(r)
        u[inside < order] = 0
        k, bits = _best_rice(u, starts, sizes)
        residuals[order] = (u, k, bits - order * (k + 1) + 8 * order + 10 + (9 + ORDER * PRECISION) * (order == ORDER))
    cost1, cost2 = residuals[1][2], np.where(usable, residuals[ORDER][2], 1 << 60)
    order = np.where(cost2 < cost1, ORDER, 1)
    coded = ~flat & (np.minimum(cost1, cost2) < 8 * sizes)
    k = np.where(order == 1, residuals[1][1], residuals[ORDER][1])

    prefixes, lead_bits = [], np.zeros(len(sizes), dtype=np.int64)
    for i, (s, number) in enumerate(zip(samples, numbers, strict=True)):
        raw, head = (s.astype(np.int8)).tobytes(), frame_header(number, len(s))
        if flat[i]:
            lead, extra, n = head + b"\x00" + raw[:1], 0, 0
        elif not coded[i]:
            lead, extra, n = head + b"\x02" + raw, 0, 0
        elif order[i] == 1:
            lead, extra, n = head + b"\x12" + raw[:1], int(k[i]), 10
        else:
            lead, extra, n = head + bytes([(0x20 | ORDER - 1) << 1]) + raw[:ORDER], PRECISION - 1 << 5 | int(shifts[i]), 9
            for c in coefficients[:, i].tolist():
                extra, n = extra << PRECISION | c & (1 << PRECISION) - 1, n + PRECISION
            extra, n = extra << 10 | int(k[i]), n + 10
        prefixes.append((lead, extra, n))
        lead_bits[i] = 8 * len(lead) + n

    per_sample = np.repeat(coded, sizes) & (inside >= np.repeat(order, sizes))
    u = np.where(np.repeat(order == 1, sizes), residuals[1][0], residuals[ORDER][0])[per_sample]
    ks = np.repeat(k, sizes)[per_sample].astype(np.int32)
    q = u >> ks
    length = (q + 1 + ks).astype(np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)[per_sample]
    body = np.bincount(which, weights=length, minlength=len(sizes)).astype(np.int64)
    total = (lead_bits + body + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(total)[:-1]])
    bits = np.zeros(8 * int(total.sum()), dtype=np.uint8)
    ends = np.cumsum(length)
    before = np.concatenate([[0], np.cumsum(body)[:-1]])
    end = (8 * at + lead_bits - before)[which] + ends  # after each code
    bits[end - ks - 1] = 1
    for j in range(int(ks.max(initial=0))):
        has = ks > j
        bits[end[has] - 1 - j] = u[has] >> j & 1
    data = np.packbits(bits)
    for (lead, extra, n), a in zip(prefixes, at.tolist(), strict=True):
        data[a : a + len(lead)] = np.frombuffer(lead, np.uint8)
        if n:
            tail, size = extra << -n % 8, (n + 7) // 8
            data[a + len(lead) : a + len(lead) + size] |= np.frombuffer(tail.to_bytes(size, "big"), np.uint8)
    inner = np.ones(len(data), dtype=bool)
    inner[at + total - 2] = inner[at + total - 1] = False
    checks = crc16_each(data[inner], at - 2 * np.arange(len(at)), total - 2)
    data[at + total - 2], data[at + total - 1] = checks >> 8, checks & 255
    whole = data.tobytes()
    return [whole[a : a + n] for a, n in zip(at.tolist(), total.tolist(), strict=True)]


def encode(payloads: list[bytes], frames: int = FRAMES) -> list[bytes]:
    """FLAC streams of the payloads; a byte is the sample that lies 128 lower. Each frame has a seek point."""
    cuts = [(d, n, np.frombuffer(p, np.uint8)[a : a + BLOCK].astype(np.int16) - 128) for d, p in enumerate(payloads) for n, a in enumerate(range(0, len(p), BLOCK))]
    done: list[list[bytes]] = [[] for _ in payloads]
    for k in range(0, len(cuts), frames):
        part = cuts[k : k + frames]
        for (d, _, _), f in zip(part, _encode_frames([c[2] for c in part], [c[1] for c in part]), strict=True):
            done[d].append(f)
    out = []
    for p, own in zip(payloads, done, strict=True):
        sizes, at, table = [len(f) for f in own], 0, []
        for n, s in enumerate(sizes):
            table.append((n * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - n * BLOCK).to_bytes(2, "big"))
            at += s
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
        seek = b"".join(table)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


def parse_metadata(data: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples in all, their MD5, the seek points (sample, offset, samples), and where frames begin."""
    if data[:4] != b"fLaC":
        raise BadStream("no FLAC stream")
    at, last, total, md5, seek = 4, False, None, b"", []
    while not last:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        last, body = bool(kind & 128), data[at + 4 : at + 4 + size]
        at += 4 + size
        if at > len(data):
            raise BadStream("metadata ends early")
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise BadStream("not 8-bit mono")
        elif kind & 127 == 3:
            points = (body[k : k + 18] for k in range(0, size, 18))
            seek = [(int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big"), int.from_bytes(p[16:], "big")) for p in points if p[:8] != b"\xff" * 8]
    if total is None:
        raise BadStream("no stream information")
    return total, md5, seek, at


def parse_header(data: bytes, at: int) -> tuple[int, int]:
    """Block size and length of the frame header at ``at``; its checksum is verified."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise BadStream("no frame")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] not in (0x00, 0x02):
        raise BadStream("not 8-bit mono")
    n = at + 4
    lead = data[n]
    n += 1 if lead < 128 else 8 - (lead ^ 255).bit_length()
    if size_code == 6:
        size, n = data[n] + 1, n + 1
    elif size_code == 7:
        size, n = int.from_bytes(data[n : n + 2], "big") + 1, n + 2
    else:
        size = 192 if size_code == 1 else 576 << size_code - 2 if 2 <= size_code <= 5 else 256 << size_code - 8
    n += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:n]) != data[n]:
        raise BadStream("a frame header fails its checksum")
    return size, n + 1 - at


def decode_frame(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Samples of the frame at ``at``, and its length; everything that 8-bit mono frames may use."""
    size, head = parse_header(data, at)
    place = 8 * (at + head)

    def bits(n: int) -> int:
        nonlocal place
        a, b = place // 8, (place + n + 7) // 8
        if b > len(data):
            raise BadStream("a frame ends early")
        out = int.from_bytes(data[a:b], "big") >> (8 * b - place - n) & (1 << n) - 1
        place += n
        return out

    signed = lambda n: (v := bits(n)) - (v >> n - 1 << n) if n else 0
    kind, wasted, width = bits(7), 0, 8
    if bits(1):
        wasted = 1
        while not bits(1):
            wasted += 1
        width -= wasted
    if kind == 0:
        out = [signed(width)] * size
    elif kind == 1:
        out = [signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [signed(width) for _ in range(order)]
        shift, coefficients = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else []
        if kind >= 32:
            precision, shift = bits(4) + 1, signed(5)
            coefficients = [signed(precision) for _ in range(order)]
        method, parts = bits(2), bits(4)
        if method > 1 or size >> parts < order or size % (1 << parts):
            raise BadStream("a residual breaks the format")
        for p in range(1 << parts):
            k = bits(4 + method)
            raw = bits(5) if k == (1 << 4 + method) - 1 else None
            for _ in range((size >> parts) - (order if p == 0 else 0)):
                if raw is not None:
                    r = signed(raw)
                else:
                    q = 0
                    while not bits(1):
                        q += 1
                    u = q << k | bits(k)
                    r = u >> 1 ^ -(u & 1)
                out.append(r + (sum(c * s for c, s in zip(coefficients, reversed(out[len(out) - order :]), strict=True)) >> shift))
    else:
        raise BadStream("a reserved subframe")
    end = (place + 7) // 8
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise BadStream("a frame fails its checksum")
    return np.array(out, dtype=np.int64) << wasted, end + 2 - at


def _decode_frames(frames: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """Samples of whole frames, given as (bytes, block size, length of header)."""
    data = np.frombuffer(b"".join(f[0] for f in frames), np.uint8)
    total = np.array([len(f[0]) for f in frames])
    at = np.concatenate([[0], np.cumsum(total)[:-1]])
    inner = np.ones(len(data), dtype=bool)
    inner[at + total - 2] = inner[at + total - 1] = False
    checks = crc16_each(data[inner], at - 2 * np.arange(len(at)), total - 2)
    if ((data[at + total - 2].astype(np.uint16) << 8 | data[at + total - 1]) != checks).any():
        raise BadStream("a frame fails its checksum")
    out: list[np.ndarray | None] = [None] * len(frames)
    rice = []
    for i, (f, size, head) in enumerate(frames):
        kind = f[head]
        if kind == 0x00:
            out[i] = np.full(size, np.frombuffer(f, np.int8, 1, head + 1)[0], dtype=np.int64)
        elif kind == 0x02 and len(f) >= head + 3 + size:
            out[i] = np.frombuffer(f, np.int8, size, head + 1).astype(np.int64)
        else:
            order, linear = (kind >> 1) - 8 if kind < 0x40 else (kind >> 1) - 31, kind >= 0x40
            place = head + 1 + order
            n = 0
            shift, coefficients = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if not linear and order <= 4 else []
            top = int.from_bytes(f[place : place + 80], "big")
            width = 8 * len(f[place : place + 80])
            if linear:
                precision = (top >> width - 4) + 1
                shift = top >> width - 9 & 31
                n = 9
                for _ in range(order):
                    n += precision
                    c = top >> width - n & (1 << precision) - 1
                    coefficients.append(c - (c >> precision - 1 << precision))
            packed = top >> width - n - 10 & 1023
            k = packed & 15
            if kind & 1 or packed >> 4 or k == 15 or shift > 15 or size <= order:
                out[i] = decode_frame(f, 0)[0]
            else:
                rice.append((size - order, i, order, coefficients, shift, k, 8 * (int(at[i]) + place) + n + 10))
    if not rice:
        return out
    rice.sort(key=lambda r: -r[0])
    counts, ks = np.array([r[0] for r in rice]), np.array([r[5] for r in rice])
    bits = np.unpackbits(data)
    ones = np.append(np.flatnonzero(bits.view(bool)).astype(np.int32), np.int32(len(bits)))
    after = np.repeat(ones, np.diff(ones, prepend=-1))  # the next one at or behind each place
    place = np.array([r[6] for r in rice], dtype=np.int32)
    steps, edge = int(counts[0]), len(bits)
    stops = np.zeros((steps, len(rice)), dtype=np.int32)
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # frames with more codes than each step
    gap = (ks + 1).astype(np.int32)
    where = place.copy()
    for step, n in enumerate(active.tolist()):
        t = stops[step, :n]
        np.take(after, where[:n], out=t, mode="clip")
        where = t + gap[:n]
    ends = np.array([8 * (at[x[1]] + total[x[1]]) for x in rice])
    if (stops[counts - 1, np.arange(len(rice))] + gap > ends).any():
        raise BadStream("a residual runs out of its frame")
    starts = np.empty_like(stops)
    starts[0] = place
    np.add(stops[:-1], gap, out=starts[1:])
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    low = np.minimum(stops + 1, edge)
    rest = window[low >> 3] >> (32 - (low & 7) - ks.astype(np.int32)).astype(np.uint32) & ((1 << ks) - 1).astype(np.uint32)
    u = (stops - starts) << ks.astype(np.int32) | rest.view(np.int32)
    r = u >> 1 ^ -(u & 1)
    for order in {x[2] for x in rice}:
        own = [j for j, x in enumerate(rice) if x[2] == order]
        warm = np.array([np.frombuffer(frames[rice[j][1]][0], np.int8, order, frames[rice[j][1]][2] + 1) for j in own]).reshape(len(own), order)
        n = counts[own]
        s = np.zeros((order + int(n.max()), len(own)), dtype=np.int32)
        s[:order] = warm.T
        e = r[: int(n.max()), own]
        plain = order == 1 and all(rice[j][3] == [1] and not rice[j][4] for j in own)
        if plain:
            s[1:] = e
            np.cumsum(s, axis=0, out=s)
        else:
            c, shift = np.array([rice[j][3] for j in own], dtype=np.int32).reshape(len(own), order).T[::-1].copy(), np.array([rice[j][4] for j in own], dtype=np.int32)
            live = np.searchsorted(-n, -np.arange(int(n.max())), side="left").tolist()
            for step, m in enumerate(live):
                guess = np.einsum("of,of->f", c[:, :m], s[step : step + order, :m]) >> shift[:m] if order else 0
                s[order + step, :m] = e[step, :m] + guess
        for col, j in enumerate(own):
            out[rice[j][1]] = s[: order + rice[j][0], col]
    return out


def decode(streams: list[bytes], frames: int = FRAMES) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Payload of each stream, and its seek points (first sample, offset in the stream, samples).

    Header and frame checksums, sample counts and the MD5 of the samples are verified; BadStream
    says what fails.
    """
    parsed, cuts, parts = [], [], [[] for _ in streams]
    for d, data in enumerate(streams):
        total, md5, seek, begin = parse_metadata(data)
        points = []
        if sum(p[2] for p in seek) == total:
            offsets = [p[1] for p in seek] + [len(data) - begin]
            for (sample, offset, samples), end in zip(seek, offsets[1:], strict=True):
                size, head = parse_header(data, begin + offset)
                if size != samples or end <= offset:
                    raise BadStream("a seek point and its frame differ")
                cuts.append((d, (data[begin + offset : begin + end], size, head)))
                points.append((sample, begin + offset, samples))
        else:
            at, sample = begin, 0
            while at < len(data):
                own, n = decode_frame(data, at)
                parts[d].append(own)
                points.append((sample, at, len(own)))
                at, sample = at + n, sample + len(own)
        parsed.append((total, md5, points))
    for k in range(0, len(cuts), frames):
        part = cuts[k : k + frames]
        for (d, _), s in zip(part, _decode_frames([c[1] for c in part]), strict=True):
            parts[d].append(s)
    out = []
    for (total, md5, points), own in zip(parsed, parts, strict=True):
        s = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
        if len(s) != total or len(s) and (s.min() < -128 or s.max() > 127):
            raise BadStream("samples and stream information differ")
        signed = s.astype(np.int8)
        if md5 != bytes(16) and hashlib.md5(signed.tobytes(), usedforsecurity=False).digest() != md5:
            raise BadStream("the samples fail their MD5")
        out.append(((signed.view(np.uint8) ^ 128).tobytes(), points))
    return out


def feature(payload: bytes) -> str:
    """Samples, mean, root mean square, peak and zero crossings of the samples."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(s):
        return "samples=0"
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"samples={len(s)};mean={int(s.sum()) / len(s):.4f};rms={(int((s * s).sum()) / len(s)) ** 0.5:.4f};peak={int(np.abs(s).max())};crossings={crossings}"


def _groups(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def padded(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64; null is empty."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def encode_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Replace ``text`` by ``n_bytes`` (its UTF-8 bytes) and ``out``, a FLAC stream of its padded bytes.

    Null texts are empty; an empty text gives 64 samples. The stream depends on the text alone, so
    copies have equal streams. Other columns stay, but those named like the added ones are replaced.
    An empty table gives no rows.
    """
    kept = [c for c in df.columns if c.lower() not in (text.lower(), out.lower(), "n_bytes")]
    rows = df.select(*kept, text)
    schema = df.select(*kept).schema.add("n_bytes", "long").add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [x.as_buffer().size if x.is_valid else 0 for x in b.column(len(kept)).cast(pa.large_binary())]
            for s in _groups(sizes):
                part = b.slice(s.start, s.stop - s.start)
                media = encode([padded(x) for x in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(sizes[s], pa.int64()), pa.array(media, pa.binary())], [*kept, "n_bytes", out])

    return rows.mapInArrow(run, schema)


SEEK = T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("samples", T.LongType())]))


def _row(decoded: tuple[bytes, list[tuple[int, int, int]]]) -> tuple[bytes, list[dict], str]:
    payload, points = decoded
    return payload, [dict(zip(("sample", "offset", "samples"), p, strict=True)) for p in points], feature(payload)


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``payload`` (binary), ``seek`` (first sample, byte offset and samples of each block) and ``feature``.

    A null stream gives nulls. A damaged one raises BadStream. Columns named like the added ones
    are replaced.
    """
    added = ("payload", "seek", "feature")
    kept = [c for c in df.columns if c.lower() not in added]
    at = kept.index(media)
    schema = df.select(*kept).schema.add("payload", T.BinaryType()).add("seek", SEEK).add("feature", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _groups([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at)]):
                part = b.slice(s.start, s.stop - s.start)
                streams = part.column(at).to_pylist()
                done = iter(decode([x for x in streams if x is not None]))
                rows = [_row(next(done)) if x is not None else (None, None, None) for x in streams]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("samples", pa.int64())])), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*kept, *added])

    return df.select(*kept).mapInArrow(run, schema)


def pcm_blocks(decoded: DataFrame, key: str) -> DataFrame:
    """One row per block: ``key``, ``block``, ``first_sample``, ``samples`` and ``pcm`` (unsigned 8-bit)."""
    each = decoded.select(F.col(key), "payload", F.posexplode("seek").alias("block", "s"))
    pcm = F.substr(F.col("payload"), (F.col("s.sample") + 1).cast("int"), F.col("s.samples").cast("int"))
    return each.select(key, "block", F.col("s.sample").alias("first_sample"), F.col("s.samples").alias("samples"), pcm.alias("pcm"))


def write_pcm_blocks(decoded: DataFrame, key: str, path: str) -> None:
    """Write the blocks as Parquet, so that a reader finds any sample by ``key`` and ``first_sample``."""
    pcm_blocks(decoded, key).write.parquet(path)
