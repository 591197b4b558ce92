"""Operator 7: FLAC media columns. Payload bytes become 8-bit mono samples; frames of 256 samples are coded and decoded side by side.

Encoding picks for each frame the shortest of a constant, fixed predictors of order 0 and 1, a quantised linear predictor
of order 2, each with a Rice-coded residual, and plain samples. Streams carry STREAMINFO with an MD5 sum and a seek table
with a sample offset for each 16th frame. Decoding finds frames by their header and its check sum, verifies each frame's
check sum, decodes the Rice residuals of many frames in step, undoes the predictors and verifies the MD5 sum.
``decode_range`` starts at the seek point before a sample; ``write_pcm`` writes blocks of samples with their sample offsets,
which ``read_pcm`` finds again. The query writes the media to the shared folder and computes its columns from what it reads there.

The decoder reads mono 8-bit streams of fixed block size, with constant, plain, fixed (order 0 to 4) and linear (order 1 to
32) subframes and residuals in any partitions, escaped ones too; others raise ValueError. Long streams are coded a portion of
frames at a time. Null text counts as empty (a payload of 64 zeros). Repeated rows give equal results; other columns are
ignored; a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._bytes import portions, ragged, utf8
from meridax.llm._scratch import discard, staged

BLOCK, SEEK_EVERY, RATE = 256, 16, 8000


def _table(width: int, poly: int) -> np.ndarray:
    """The check-sum table of a polynomial of ``width`` bits."""
    t = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        t = np.where(t >> (width - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t.astype(np.int32)


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def check_sums(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The check sums of all ranges, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(start), np.int32)
    active = len(start)
    for j in range(int(size[0]) if len(size) else 0):
        while size[active - 1] <= j:
            active -= 1
        byte = data[start[:active] + j]
        crc[:active] = _CRC8[crc[:active] ^ byte] if width == 8 else ((crc[:active] << 8) & 0xFFFF) ^ _CRC16[(crc[:active] >> 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


_NUMBER_ENDS = (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31)


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded numbers below 2**31, as bytes (n, 6) and their count: the scheme of UTF-8, carried on to six bytes."""
    size = 1 + sum((n >= end).astype(np.int64) for end in _NUMBER_ENDS[:-1])
    out = np.zeros((len(n), 6), np.uint8)
    for s in np.unique(size).tolist():
        rows = size == s
        out[rows, 0] = (0 if s == 1 else 0xFF << (8 - s) & 0xFF) | (n[rows] >> (6 * (s - 1)))
        for k in range(1, s):
            out[rows, k] = 0x80 | ((n[rows] >> (6 * (s - 1 - k))) & 0x3F)
    return out, size


class _Bits:
    """A bit array that fields are put into."""

    def __init__(self, size: int):
        self.bits = np.zeros(size, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        value = np.broadcast_to(value, at.shape)
        for j in range(width):
            self.bits[at + j] = (value >> (width - 1 - j)) & 1


def encode(payload: np.ndarray, at: np.ndarray, *, frames_at_once: int = 2048) -> list[bytes]:
    """A FLAC stream for each range ``payload[at[i]:at[i+1]]`` of unsigned bytes. ``frames_at_once`` bounds the working space, whatever the length of a stream."""
    sizes = np.diff(at)
    frames = -(-sizes // BLOCK)
    total = int(frames.sum())
    stream = np.repeat(np.arange(len(sizes)), frames)
    first = np.cumsum(frames) - frames
    number = np.arange(total) - first[stream]
    begin = at[:-1][stream] + number * BLOCK
    size = np.minimum(BLOCK, at[1:][stream] - begin)
    parts = [_encode_frames(payload, begin[a : a + frames_at_once], size[a : a + frames_at_once], number[a : a + frames_at_once]) for a in range(0, total, frames_at_once)]
    data = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint8)
    length = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)
    start = np.cumsum(length) - length
    streams = []
    edges = np.append(start, len(data))
    for i, n in enumerate(sizes):
        a, b = int(first[i]), int(first[i] + frames[i])
        pcm = (payload[at[i] : at[i + 1]] ^ 0x80).tobytes()  # signed samples
        points = range(a, b, SEEK_EVERY)
        sizes_ = length[a:b] if b > a else np.zeros(1, np.int64)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes_.min()).to_bytes(3, "big") + int(sizes_.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | int(n)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        seek = b"".join(struct.pack(">QQH", (p - a) * BLOCK, int(start[p] - start[a]), int(size[p])) for p in points)
        # a block of metadata holds 2**24 bytes: very long streams have seek points farther apart
        every = -(-len(seek) // (18 * 900_000)) or 1
        seek = b"".join(seek[18 * k : 18 * k + 18] for k in range(0, len(seek) // 18, every)) if every > 1 else seek
        streams.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[edges[a] : edges[b]].tobytes())
    return streams


def _encode_frames(payload: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these frames in a row, and the length of each."""
    total = len(begin)
    place = np.arange(BLOCK)
    valid = place < size[:, None]
    s = np.zeros((total, BLOCK), np.int32)
    s[valid] = payload[ragged(begin, size)].astype(np.int32) - 128
    # residuals of each predictor; the first ``order`` samples stay as they are and aren't coded
    one = s.copy()
    one[:, 1:] -= s[:, :-1]
    f = s.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1) + 1e-9, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1 + 1e-6
    coef = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    coef = np.clip(np.rint(coef * 32), -64, 63).astype(np.int32)
    linear = s.copy()
    linear[:, 2:] -= (coef[:, :1] * s[:, 1:-1] + coef[:, 1:] * s[:, :-2]) >> 5
    ragged_rows = np.flatnonzero(size < BLOCK)
    bits = np.empty((3, total), np.int64)
    param = np.empty((3, total), np.int32)
    coded_as = []
    for kind, (order, e, head) in enumerate(((0, s, 8), (1, one, 9), (2, linear, 33))):
        u = _zigzag(e)
        u[:, :order] = 0
        u[ragged_rows] *= valid[ragged_rows]
        sums, n = u.sum(1, dtype=np.int64), np.maximum(size - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(sums * 0.69 / n, 0.5))).astype(np.int32), 0, 14)
        coded_as.append(u)
        param[kind] = k
        # what the quotients take, about: rounding down saves half a bit less a share of 2**k
        bits[kind] = (sums >> k) - ((size - order) * ((1 << k) - 1) >> (k + 1)) + (size - order) * (k + 1) + 8 * order + head + 10 - 8
    best = bits.argmin(0)
    constant = (np.where(valid, s, s[:, :1]) == s[:, :1]).all(1)
    plain = bits.min(0) >= 8 * size
    kind = np.where(constant, 5, np.where(plain, 4, best))
    order = np.array([0, 1, 2, 0, 0, 0])[kind]
    k = param[best, np.arange(total)]
    rice = kind < 3
    coded = valid & (place >= order[:, None]) & rice[:, None]
    u = np.choose(best[:, None], coded_as)
    q = u >> k[:, None]
    lengths = np.where(coded, q + 1 + k[:, None], 0)
    name, name_size = _frame_number(number)
    head = 4 + name_size + 1 + 1  # with the block size and the check sum
    fixed = 8 + np.where(rice, 8 * order + 10 + np.where(kind == 2, 9 + 2 * 7, 0), np.where(kind == 4, 8 * size, 8))
    body = (fixed + lengths.sum(1) + 7) // 8
    length = head + body + 2
    start = np.cumsum(length) - length
    out = _Bits(int(length.sum()) * 8)
    bit = start * 8
    out.put(bit, np.int64(0xFFF8), 16)
    out.put(bit + 16, np.int64(0x6002), 16)
    for j in range(6):
        rows = name_size > j
        out.put(bit[rows] + 32 + 8 * j, name[rows, j].astype(np.int64), 8)
    out.put(bit + 8 * (head - 2), size - 1, 8)
    sub = bit + 8 * head
    out.put(sub, np.array([0x10, 0x12, 0x42, 0x00, 0x02, 0x00])[kind], 8)
    at_bit = sub + 8
    for j in (0, 1):
        rows = (order > j) & rice
        out.put(at_bit[rows] + 8 * j, s[rows, j] & 255, 8)
    at_bit = at_bit + 8 * order
    rows = kind == 2
    out.put(at_bit[rows], np.int64(6 << 5 | 5), 9)
    for j in (0, 1):
        out.put(at_bit[rows] + 9 + 7 * j, coef[rows, j] & 127, 7)
    at_bit = at_bit + np.where(rows, 23, 0)
    out.put(at_bit[rice], k[rice], 10)
    rows = kind == 5
    out.put(sub[rows] + 8, s[rows, 0] & 255, 8)
    rows = np.flatnonzero(kind == 4)
    if len(rows):
        cells = valid[rows]
        spots = (sub[rows] + 8)[:, None] + 8 * place
        out.put(spots[cells], s[rows][cells] & 255, 8)
    spot = (at_bit + 10)[:, None] + np.cumsum(lengths, 1) - lengths
    mask = coded
    stop = (spot + q)[mask]
    out.bits[stop] = 1
    value, width = u[mask], np.broadcast_to(k[:, None], u.shape)[mask]
    for j in range(int(width.max()) if len(width) else 0):
        rows = width > j
        out.bits[(stop + 1 + j)[rows]] = (value[rows] >> (width[rows] - 1 - j)) & 1
    data = np.packbits(out.bits)
    data[start + head - 1] = check_sums(data, start, head - 1, 8)
    crc = check_sums(data, start, length - 2, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 255
    return data, length


def read_header(stream: bytes) -> dict:
    """Total samples, MD5 sum, seek points (sample, byte offset from the first frame, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out = 4, {"seek": []}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"samples": packed & ((1 << 36) - 1), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "md5": body[18:34], "block": struct.unpack(">H", body[:2])[0]}
        elif kind & 127 == 3:
            out["seek"] = [struct.unpack_from(">QQH", body, k) for k in range(0, size, 18)]
        at += 4 + size
        if kind & 128:
            return out | {"frames_at": at}


def decode(streams: list[bytes], *, frames_at_once: int = 4096) -> list[bytes]:
    """The unsigned payload of each stream; raises ValueError on a damaged frame or a wrong sum."""
    heads = [read_header(s) for s in streams]
    counts = [-(-h["samples"] // h["block"]) for h in heads]
    pcm = decode_frames([s[h["frames_at"] :] for s, h in zip(streams, heads)], heads, [0] * len(streams), counts, frames_at_once)
    out = []
    for h, x in zip(heads, pcm):
        if len(x) != h["samples"] or (any(h["md5"]) and hashlib.md5(x).digest() != h["md5"]):
            raise ValueError("wrong MD5 sum")
        out.append((np.frombuffer(x, np.uint8) ^ 0x80).tobytes())
    return out


def decode_range(stream: bytes, first: int, count: int) -> bytes:
    """The unsigned payload from sample ``first`` on, decoded from the seek point before it; only the frames it needs are read and verified."""
    h = read_header(stream)
    first, last = max(0, min(first, h["samples"])), max(0, min(first + count, h["samples"]))
    if first >= last:
        return b""
    points = [x for x in h["seek"] if x[0] <= first and x[0] < (1 << 63)] or [(0, 0, 0)]
    sample, offset, _ = max(points)
    beyond = [x[1] for x in h["seek"] if x[0] >= last and x[0] < (1 << 63)]
    body = stream[h["frames_at"] + offset : h["frames_at"] + min(beyond) if beyond else len(stream)]
    frame = sample // h["block"]
    frames = -(-last // h["block"]) - frame
    pcm = decode_frames([body], [h], [frame], [frames], 4096, whole=False)[0]
    return (np.frombuffer(pcm, np.uint8)[first - sample : last - sample] ^ 0x80).tobytes()


def decode_frames(bodies: list[bytes], heads: list[dict], begins: list[int], counts: list[int], frames_at_once: int, whole: bool = True) -> list[bytes]:
    """The signed samples of ``counts`` frames of each body, which begins with the frame of number ``begins``. Unless ``whole``, more frames may follow."""
    if any(h["bits"] != 8 or h["channels"] != 1 for h in heads):
        raise ValueError("only mono streams of 8 bits")
    raw = np.frombuffer(b"".join(bodies) + bytes(16), np.uint8)
    ends = np.cumsum([len(x) for x in bodies])
    counts, begins = np.array(counts, np.int64), np.array(begins, np.int64)
    block = max([h["block"] for h in heads], default=1)
    start, number, size, head = _frames(raw, ends, begins, counts, whole)
    stream = np.repeat(np.arange(len(bodies)), counts)
    stop = np.append(start[1:], ends[-1] if len(ends) else 0)
    lasts = np.cumsum(counts)[counts > 0] - 1
    stop[lasts] = ends[counts > 0]
    if not whole and len(lasts):  # the frame after the last one, if there, ends it
        stop[lasts] = np.minimum(stop[lasts], _next_header(raw, start[lasts], ends[counts > 0]))
    length = stop - start
    crc = check_sums(raw, start, length - 2, 16)
    wrong = crc != raw[start + length - 2].astype(np.int32) * 256 + raw[start + length - 1]
    if wrong.any():
        raise ValueError(f"damaged frame {number[wrong][0]} of stream {stream[wrong][0]}")
    parts = []
    for a in range(0, len(start), frames_at_once):
        b = min(a + frames_at_once, len(start))
        low, high = int(start[a]), int(stop[b - 1])
        samples = _subframes(raw[low : high + 16], (start[a:b] - low + head[a:b]) * 8, size[a:b], block)
        parts.append((samples & 255).astype(np.uint8)[np.arange(block) < size[a:b, None]])
    pcm = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return [pcm[a:b].tobytes() for a, b in zip(edges, edges[1:])]


#: Block sizes by their code, 0 where the size follows the number.
_BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])


def _headers(raw: np.ndarray):
    """Places with a frame header and its right check sum: the place, the frame's number, its samples, the header's length."""
    spots = np.flatnonzero((raw[:-16] == 0xFF) & (raw[1:-15] == 0xF8) & (raw[2:-14] >= 0x10) & (raw[3:-13] & 0xF9 == 0) & (raw[2:-14] & 15 != 15))
    spots = spots[np.isin(raw[spots + 3] >> 1 & 7, (0, 1))]
    lead = raw[spots + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 9, 1, 2, 3, 4, 5], 9)
    spots, lead, more = (x[more < 9] for x in (spots, lead, more))
    value = np.where(more == 0, lead, lead & (0x3F >> more))
    for k in range(1, 6):
        value = np.where(more >= k, value << 6 | (raw[np.minimum(spots + 4 + k, len(raw) - 1)] & 0x3F), value)
    code, rate = raw[spots + 2] >> 4, raw[spots + 2] & 15
    at = spots + 5 + more
    own = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    byte = lambda k: raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64)
    size = np.where(code == 6, byte(0) + 1, np.where(code == 7, byte(0) * 256 + byte(1) + 1, _BLOCK_SIZES[code]))
    head = 5 + more + own + np.where(rate == 12, 1, np.where(rate >= 13, 2, 0))
    good = check_sums(np.append(raw, np.zeros(16, np.uint8)), spots, head, 8) == raw[np.minimum(spots + head, len(raw) - 1)]
    return spots[good], value[good], size[good], head[good] + 1


def _next_header(raw: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    spots = _headers(raw)[0]
    after = np.append(spots, 1 << 62)[np.searchsorted(spots, start, "right")]
    out = np.minimum(after, ends)
    for i, (a, b, end) in enumerate(zip(start.tolist(), out.tolist(), ends.tolist())):  # a chance look-alike doesn't end a frame: its check sum does
        while b < end and int(check_sums(raw, np.array([a]), np.array([b - a - 2]), 16)[0]) != int(raw[b - 2]) * 256 + int(raw[b - 1]):
            b = int(min(np.append(spots, end)[np.searchsorted(spots, b, "right")], end))
        out[i] = b
    return out


def _frames(raw, ends, begins, counts, whole):
    """Starts, numbers, sizes and header lengths of the wanted frames: places with a frame header and the next number."""
    spots, value, size, head = _headers(raw)
    owner = np.searchsorted(ends, spots, "right")
    expected = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    if len(spots) != len(expected) or (value != expected).any():
        keep, wanted, last = [], 0, -1  # chance look-alikes inside frames, and frames beyond the wanted ones: keep the next number only
        for i, (v, o) in enumerate(zip(value.tolist(), owner.tolist())):
            if o != last and o < len(begins):
                wanted, last = int(begins[o]), o
            if o < len(begins) and v == wanted and wanted < begins[o] + counts[o]:
                keep.append(i)
                wanted += 1
        spots, value, size, head = (x[keep] for x in (spots, value, size, head))
        if len(spots) != len(expected) or (value != expected).any():
            raise ValueError("frames are missing")
    return spots, value, size, head


def _subframes(raw: np.ndarray, bit: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """The samples (frames, ``block``) of subframes that begin at the given bits."""
    wide = np.append(raw, np.zeros(8, np.uint8)).astype(np.int64)
    word = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]  # 32 bits from each byte

    def get(at, width):
        return (word[at >> 3] >> (32 - (at & 7) - width)) & ((1 << width) - 1)

    def signed(at, width):
        x = get(at, width)
        return np.where(width > 0, x - ((x >> np.maximum(width - 1, 0)) << width), 0)

    head = get(bit, 8)
    if (head & 0x81).any():
        raise ValueError("wasted bits or a damaged subframe")
    kind = head >> 1
    bit = bit + 8
    n, place = len(bit), np.arange(block)
    out = np.zeros((n, block), np.int64)
    rows = kind == 0
    out[rows] = signed(bit[rows], 8)[:, None]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        cells = place < size[rows][:, None]
        part = np.zeros((len(rows), block), np.int64)
        part[cells] = signed((bit[rows][:, None] + 8 * place)[cells], 8)
        out[rows] = part
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise ValueError("unknown subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    for j in range(int(order.max()) if n else 0):
        rows = order > j
        out[rows, j] = signed(bit[rows] + 8 * j, 8)
    bit = bit + 8 * order
    coefs, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
    if linear.any():
        width = np.where(linear, get(bit, 4) + 1, 0)
        shift = np.where(linear, get(bit + 4, 5), 0)
        bit = np.where(linear, bit + 9, bit)
        for j in range(int(order[linear].max())):
            for w in np.unique(width[linear & (order > j)]):
                rows = linear & (order > j) & (width == w)
                coefs[rows, j] = signed(bit[rows] + int(w) * j, int(w))
        bit = bit + width * np.where(linear, order, 0)
    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        rows = rows[np.argsort(-(size[rows] - order[rows]), kind="stable")]
        _restore(out, rows, _residuals(raw, get, signed, bit[rows], size[rows], order[rows], block), order, kind, coefs, shift, size)
    return out


def _residuals(raw, get, signed, bit, size, order, block):
    """The Rice-coded residuals of frames in order of falling length, a sample of each at a time. A partition begins with its parameter, or with the width of plain numbers."""
    method, parts = get(bit, 2), get(bit + 2, 4)
    if (method > 1).any() or (size % (1 << parts) != 0).any():
        raise ValueError("unknown residual")
    each, wide = size >> parts, 4 + method
    spot, k, plain = bit + 6, np.zeros(len(bit), np.int64), np.zeros(len(bit), bool)
    # from each bit, the next that is set
    bits = np.unpackbits(raw)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    after = np.minimum.accumulate(ones[::-1])[::-1]
    residual = np.zeros((len(bit), block), np.int64)
    coded = size - order
    active, split, odd = len(bit), bool(parts.any()), False
    for j in range(int(coded[0]) if len(coded) else 0):
        while coded[active - 1] <= j:
            active -= 1
        if j == 0 or split:
            new = np.flatnonzero((j == 0) | ((order[:active] + j) % each[:active] == 0))
            if len(new):
                k[new] = get(spot[new], wide[new])
                plain[new] = k[new] == (1 << wide[new]) - 1
                spot[new] += wide[new]
                some = new[plain[new]]
                k[some] = get(spot[some], 5)
                spot[some] += 5
                odd = bool(plain.any())
        a, kk = spot[:active], k[:active]
        stop = after[np.minimum(a, len(after) - 1)].astype(np.int64)
        low = get(stop + 1, kk)
        u = ((stop - a) << kk) | low
        value, step = (u >> 1) ^ -(u & 1), stop + 1 + kk - a
        if odd:
            value = np.where(plain[:active], signed(a, kk), value)
            step = np.where(plain[:active], kk, step)
        residual[:active, j] = value
        spot[:active] = a + step
    return residual


def _restore(out, rows, residual, order, kind, coefs, shift, size):
    """Undo the predictors: sums for fixed ones, sample by sample over all frames for linear ones."""
    for p in np.unique(order[rows]):
        for is_linear in (False, True):
            pick = (order[rows] == p) & ((kind[rows] >= 32) == is_linear)
            own = rows[pick]
            if not len(own):
                continue
            block = out.shape[1]
            e = residual[pick][:, : block - p]
            if is_linear:
                for i in range(int(p), block):
                    guess = sum(coefs[own, j] * out[own, i - 1 - j] for j in range(int(p)))
                    out[own, i] = (guess >> shift[own]) + e[:, i - p]
            else:
                warm = out[own, :p]
                for d in range(int(p), 0, -1):  # differences of the warm-up give the start of each sum
                    e = np.concatenate([np.diff(warm[:, :d], n=d - 1, axis=1), e], 1).cumsum(1)
                out[own] = e[:, :block]


def _payload(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with zeros appended up to a positive multiple of 64."""
    sizes = np.diff(at)
    full = np.maximum(64, -(-sizes // 64) * 64)
    edges = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(edges[-1]), np.uint8)
    out[ragged(edges[:-1], sizes)] = data
    return out, edges


def store(docs: DataFrame, *, portion_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes and media: the text as a FLAC stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", portion_bytes):
            data, at = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(encode(*_payload(data, at)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def features(pcm: np.ndarray) -> str:
    """Samples, root mean square, zero crossings and peak of signed samples, as text."""
    x = pcm.astype(np.int64)
    return f"n={len(x)};rms={int(np.sqrt((x * x).mean()) * 1000)};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())};mean={int(x.mean() * 1000)}"


def pcm_blocks(media: DataFrame, *, block_samples: int = 1 << 16, portion_bytes: int = 1 << 19) -> DataFrame:
    """(doc_id, media_sha256, first_sample, samples, pcm): the decoded signed samples in blocks, each with its sample offset. Long streams are decoded a block at a time, from seek points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "media", portion_bytes):
            for doc_id, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, name = read_header(stream)["samples"], hashlib.sha256(stream).hexdigest()
                for first in range(0, total, block_samples):
                    pcm = bytes(np.frombuffer(decode_range(stream, first, block_samples), np.uint8) ^ 0x80)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([name]), pa.array([first], pa.int64()), pa.array([len(pcm)], pa.int32()), pa.array([pcm], pa.binary())], ["doc_id", "media_sha256", "first_sample", "samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, media_sha256 string, first_sample long, samples int, pcm binary")


def write_pcm(media: DataFrame, path: str, **options) -> None:
    """The table of PCM blocks, ordered by stream and sample within each file, so that a reader skips all blocks but those it needs."""
    pcm_blocks(media, **options).sortWithinPartitions("doc_id", "media_sha256", "first_sample").write.parquet(path)


def read_pcm(spark: SparkSession, path: str, doc_id: int, first: int, count: int) -> bytes:
    """Signed samples ``first`` to ``first + count`` of one document, from the blocks that hold them (of equal documents, of one)."""
    rows = spark.read.parquet(path).where((F.col("doc_id") == doc_id) & (F.col("first_sample") < first + count) & (F.col("first_sample") + F.col("samples") > first)).orderBy("media_sha256", "first_sample").collect()
    blocks = {r.first_sample: bytes(r.pcm) for r in rows if r.media_sha256 == rows[0].media_sha256}
    return b"".join(x[max(0, first - at) : max(0, first + count - at)] for at, x in sorted(blocks.items()))


def load(media: DataFrame, *, portion_bytes: int = 1 << 19, with_payload: bool = False) -> DataFrame:
    """Decode the stored column: payload sums, the stored form's sum, features, the seek table and, with ``with_payload``, the payload."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek array<struct<sample:long,offset:long>>, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "media", portion_bytes):
            streams = batch.column(2).to_pylist()
            out = decode(streams)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            seek = [[{"sample": a, "offset": b} for a, b, _ in read_header(s)["seek"]] for s in streams] if with_payload else [None] * len(streams)
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in out]), pa.array([sha(x) for x in out]), pa.array([zlib.crc32(x[-64:]) for x in out], pa.int64()), pa.array([len(s) for s in streams]), pa.array([sha(s) for s in streams])]
            columns += [pa.array([features((np.frombuffer(x, np.uint8) ^ 0x80).view(np.int8)) for x in out]), pa.array(seek, pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64())]))), pa.array(out if with_payload else [None] * len(out), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kinds.split(", ")])

    out = media.mapInArrow(read, kinds)
    return out if with_payload else out.drop("seek", "payload")


def stored_features(spark: SparkSession, docs: DataFrame, *, waves: int = 2) -> DataFrame:
    """What ``load`` gives, from media written to the shared folder and read back. A wave's media go once its features are written, which bounds the space that media take there."""
    out = None
    wave = F.pmod(F.xxhash64("doc_id", "text"), F.lit(waves))
    for k in range(waves):
        media = staged(spark, store(docs.where(wave == k)), "media")
        seen = staged(spark, load(media), "media-features")
        discard(spark, media)
        out = seen if out is None else out.unionByName(seen)
    return out


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
