from __future__ import annotations

import random

import numpy as np
import pytest

from pathsonde.llm import flac


def payloads():
    rng = random.Random(3)
    out = [b"", b"a", b"ab" * 3000, bytes(64), bytes([255]) * 9000, bytes(range(256)) * 40, b"The quick brown fox " * 500]
    out += [bytes(rng.choices(range(256), k=rng.choice([1, 64, 4096, 4097, 9999]))) for _ in range(6)]
    out += [bytes(rng.choices(b"etaoin shrdlu", k=k)) for k in (16, 17, 64, 128, 4095, 4096, 8192, 100_000)]
    wave = (128 + 90 * np.sin(np.arange(20_000) / 30) + 5 * np.sin(np.arange(20_000) / 3)).astype(np.uint8)
    return [*out, wave.tobytes()]


def test_round_trip():
    data = payloads()
    streams = flac.encode(data)
    assert [p for p, _ in flac.decode(streams)] == data
    assert streams == [flac.encode([p])[0] for p in data]  # whatever else is in the batch
    assert len(streams[-1]) < 0.6 * len(data[-1])


def test_frame_by_frame_agrees():
    for data, stream in zip(payloads(), flac.encode(payloads()), strict=True):
        at = flac.parse_metadata(stream)[3]
        own = []
        while at < len(stream):
            samples, n = flac.decode_frame(stream, at)
            own += (samples + 128).tolist()
            at += n
        assert bytes(own) == data


def test_seek_points():
    data = b"seekable text " * 2000
    stream = flac.encode([data])[0]
    for sample, offset, samples in flac.decode([stream])[0][1]:
        got, _ = flac.decode_frame(stream, offset)
        assert bytes((got + 128).tolist()) == data[sample : sample + samples]


def test_damage_is_found():
    stream = bytearray(flac.encode([b"some text to be damaged " * 400])[0])
    begin = flac.parse_metadata(bytes(stream))[3]
    for at in (0, begin, begin + 3, begin + 7, begin + 500, len(stream) - 1, len(stream) - 300):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(bad)])


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & (1 << n) - 1, f"0{n}b") if n else ""
        return self


def hand_made(subframe, size):
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0, size - 1])
    s = Bits().put(int.from_bytes(head + bytes([flac.crc8(head)]), "big"), 56).s + subframe
    s += "0" * (-len(s) % 8)
    body = int(s, 2).to_bytes(len(s) // 8, "big")
    return body + flac.crc16(body).to_bytes(2, "big")


def test_more_of_the_format():
    """Second-order fixed prediction in two partitions, one of them escaped; and wasted bits."""
    x = [0, 3, 7, 8, 2, -5, -9, -7, 1, 4, 4, 9, 20, 24, 20, 11]
    r = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, 16)]
    b = Bits().put(0, 1).put(10, 6).put(0, 1).put(x[0], 8).put(x[1], 8).put(0, 2).put(1, 4).put(2, 4)
    for v in r[:6]:
        u = 2 * v if v >= 0 else -2 * v - 1
        b.put(1, (u >> 2) + 1).put(u, 2)
    b.put(15, 4).put(6, 5)
    for v in r[6:]:
        b.put(v, 6)
    frame = hand_made(b.s, 16)
    assert flac.decode_frame(frame, 0)[0].tolist() == x
    wasted = Bits().put(0, 1).put(1, 6).put(1, 1).put(1, 2)
    for v in x:
        wasted.put(v, 6)
    assert flac.decode_frame(hand_made(wasted.s, 16), 0)[0].tolist() == [4 * (v if -32 <= v < 32 else v) for v in x]
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode([stream]) == [(bytes(v + 128 for v in x), [(0, len(stream) - len(frame), 16)])]


@pytest.mark.parametrize("n", [0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**30, 2**35])
def test_coded_numbers(n):
    head = bytes([0xFF, 0xF8, 0xC4, 0x02]) + flac.coded_number(n)
    if n < 0x110000 and not 0xD800 <= n < 0xE000:
        assert flac.coded_number(n) == chr(n).encode()
    assert flac.parse_header(head + bytes([flac.crc8(head)]), 0) == (4096, len(head) + 1)


def test_frame(spark, tmp_path):
    rows = [(1, "text " * 3000, "x"), (2, None, "y"), (3, "", "z"), (None, "é" * 70, None), (1, "text " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, MEDIA string")
    out = flac.decode_column(flac.encode_column(df))
    got = out.collect()
    assert [(r.doc_id, bytes(r.payload), r.n_bytes) for r in got] == [(d, flac.padded(t), len((t or "").encode())) for d, t, _ in rows]
    assert got[0].media == got[4].media and got[1].media == got[2].media and got[0].feature == got[4].feature
    flac.write_pcm_blocks(out.filter("doc_id = 1").limit(1), "doc_id", str(tmp_path / "pcm"))
    blocks = sorted(spark.read.parquet(str(tmp_path / "pcm")).collect(), key=lambda r: r.first_sample)
    assert b"".join(bytes(r.pcm) for r in blocks) == flac.padded(rows[0][1]) and [r.first_sample for r in blocks] == [4096 * k for k in range(4)]
    assert flac.decode_column(flac.encode_column(df.limit(0))).count() == 0
