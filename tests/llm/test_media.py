"""Media streams: round trips, seeking, PCM blocks, damage, and streams of another, plain writer."""

import hashlib
import random
import struct

import numpy as np
import pytest

from meridax.llm import flac_media

DRAW = random.Random(8)


def crc(data, width, poly):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value >> (width - 1) & 1 else value << 1) & ((1 << width) - 1)
    return value


def plain_stream(samples, block, order, parts, escape):
    """A FLAC stream, bit by bit: fixed predictors, ``2**parts`` partitions, every second one escaped if asked; no MD5 sum, no seek table."""
    frames = b""
    for number, a in enumerate(range(0, len(samples), block)):
        x = samples[a : a + block]
        assert number < 128
        head = bytes([0xFF, 0xF8, 0x70, 0x02, number]) + struct.pack(">H", len(x) - 1)
        bits = f"0{8 + order:06b}0" + "".join(f"{v & 255:08b}" for v in x[:order])
        e = list(x)
        for _ in range(order):
            e = [0] + [q - p for p, q in zip(e, e[1:])]
        p = parts if len(x) % (1 << parts) == 0 and len(x) >> parts > order else 0
        bits += "00" + f"{p:04b}"
        each = len(x) >> p
        for k in range(1 << p):
            own = e[max(order, k * each) : (k + 1) * each]
            if escape and k % 2:
                bits += "1111" + f"{12:05b}" + "".join(f"{v & 4095:012b}" for v in own)
            else:
                rice = DRAW.randrange(3, 7)
                bits += f"{rice:04b}"
                for v in own:
                    u = 2 * v if v >= 0 else -2 * v - 1
                    bits += "0" * (u >> rice) + "1" + f"{u & ((1 << rice) - 1):0{rice}b}"
        bits += "0" * (-len(bits) % 8)
        frame = head + bytes([crc(head, 8, 7)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        frames += frame + struct.pack(">H", crc(frame, 16, 0x8005))
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info + frames


@pytest.mark.parametrize("block, order, parts, escape", [(64, 0, 0, False), (96, 1, 2, False), (128, 2, 3, True), (1024, 3, 4, True), (192, 4, 1, False)])
def test_streams_of_a_plain_writer(block, order, parts, escape):
    samples = [max(-128, min(127, int(40 * np.sin(i / 9) + DRAW.gauss(0, 9)))) for i in range(block * 5 + 17)]
    got = flac_media.decode([plain_stream(samples, block, order, parts, escape)] * 2)
    assert got == [bytes((v + 128) & 255 for v in samples)] * 2


def payloads():
    text = " ".join(f"word{i % 977} and {i % 13}" for i in range(30_000)).encode()
    return [b"", b"x", bytes(64), text[:255], text[:257], text, DRAW.randbytes(5000), b"ab" * 3000, bytes(range(256)) * 20]


@pytest.mark.parametrize("at_once", [3, 2048])
def test_round_trip_and_ranges(at_once):
    given = payloads()
    data, at = np.frombuffer(b"".join(given), np.uint8), np.cumsum([0, *map(len, given)])
    streams = flac_media.encode(data, at, frames_at_once=at_once)
    assert flac_media.decode(streams, frames_at_once=at_once) == given
    assert [flac_media.decode([s])[0] for s in streams] == given
    for x, s in zip(given, streams):
        for _ in range(8):
            a, n = DRAW.randrange(len(x) + 2), DRAW.randrange(9000)
            assert flac_media.decode_range(s, a, n) == x[a : a + n]


def test_a_range_reads_only_its_frames():
    data = np.frombuffer(payloads()[5], np.uint8)
    stream = flac_media.encode(data, np.array([0, len(data)]))[0]
    head = flac_media.read_header(stream)
    sample, offset, _ = head["seek"][9]
    damaged = bytearray(stream)
    damaged[head["frames_at"] + 5 : head["frames_at"] + offset - 5] = bytes(offset - 10)
    assert flac_media.decode_range(bytes(damaged), sample + 7, 1000) == data.tobytes()[sample + 7 : sample + 1007]
    with pytest.raises(ValueError):
        flac_media.decode([bytes(damaged)])


def test_pcm_blocks_and_query(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "é"), (3, "é"), (None, "x")], "doc_id long, text string")
    media = flac_media.store(docs)
    flac_media.write_pcm(media, str(tmp_path / "pcm"), block_samples=1000)
    blocks = spark.read.parquet(str(tmp_path / "pcm")).where("doc_id = 1").orderBy("first_sample").collect()
    padded = text.encode() + bytes(-len(text) % 64)
    assert [r.first_sample for r in blocks] == list(range(0, len(padded), 1000)) and b"".join(bytes(r.pcm) for r in blocks) == bytes(x ^ 0x80 for x in padded)
    assert flac_media.read_pcm(spark, str(tmp_path / "pcm"), 1, 1990, 1020) == bytes(x ^ 0x80 for x in padded[1990:3010])
    assert flac_media.read_pcm(spark, str(tmp_path / "pcm"), 3, 0, 64) == bytes(x ^ 0x80 for x in "é".encode() + bytes(62))
    got = sorted(((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in flac_media.stored_features(spark, docs).collect()))
    pad = lambda b: b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
    assert got == sorted((i or 0, len((t or "").encode()), len(pad((t or "").encode())), hashlib.sha256(pad((t or "").encode())).hexdigest()) for i, t in [(1, text), (2, None), (3, "é"), (3, "é"), (None, "x")])
    assert flac_media.stored_features(spark, docs.where("false")).count() == 0
