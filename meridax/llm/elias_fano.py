"""Operator 2: token ids with Elias-Fano document boundaries.

The file format: a shard holds documents in ascending doc_id order. After the magic and a header come two monotone
sequences in Elias-Fano form, doc_ids and ends (ids up to and with each document), then all ids. A sequence of n values
below u keeps floor(log2(u / n)) low bits of each value packed, and the rest in unary in a bit vector; every 256th one bit
is sampled, so that ``select`` reads a few bytes. Readers find every offset and doc_id by ``select``; no table of offsets is
made. That takes about 2 + log2(u / n) bits a value.

Shards are rows of a Parquet table (``part``, ``seq``, ``image``), which Spark writes and commits to any store.

Null and empty text: only the end id. Null doc_ids come last. Rows with equal ids are ordered by a hash of their text. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridax.llm._scratch import staged
from meridax.llm.tokenizing import tokenizer_path, word_cache

MAGIC, SAMPLE = b"EFIDS\x00\x02\x00", 256
_NTH = [[k for k in range(8) if byte << k & 0x80] for byte in range(256)]  # places of a byte's ones, the highest bit first
_ONES = np.array([len(x) for x in _NTH])


class EliasFano:
    """A monotone sequence of non-negative numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        samples = -(-n // SAMPLE)
        parts = [np.frombuffer(raw, "u1", low, at), np.frombuffer(raw, "u1", high, at + low), np.frombuffer(raw, "<u4", samples, at + low + high)]
        return cls(n, low_bits, *parts), at + low + high + 4 * samples

    def select(self, i: int) -> int:
        """Value i, from the sample before it: whole bytes are counted at once, then the bits of one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, missing = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        missing += int(_ONES[self.high[at].item() & ~(0xFF >> (place & 7)) & 0xFF])  # ones of this byte before the sample
        while True:
            counts = _ONES[self.high[at : at + 64]].cumsum()
            if counts[-1] > missing:
                break
            missing, at = missing - int(counts[-1]), at + 64
        k = int(counts.searchsorted(missing, "right"))
        byte, missing = self.high[at + k].item(), missing - (int(counts[k - 1]) if k else 0)
        one = 8 * (at + k) + _NTH[byte][missing]
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        wide = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little")
        return ((one - i) << self.low_bits) | (wide >> (a & 7) & ((1 << self.low_bits) - 1))


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The image of a shard from ordered ids (null last) and each document's ids, little-endian unsigned 32-bit."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // 4 for x in ids])
    every = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(every) or int(every.max()) < 1 << 16 else 4
    head = MAGIC + struct.pack("<BqQ", width, base, len(doc_ids) - len(known))
    return head + EliasFano.of((known - base).astype(np.uint64)).to_bytes() + EliasFano.of(ends).to_bytes() + every.astype(f"<u{width}").tobytes()


class Shard:
    """Reader of a shard: ``doc_ids``, ``ends`` and ``ids``."""

    def __init__(self, image: bytes):
        raw = memoryview(image)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a shard of token ids")
        width, self.base, self.nulls = struct.unpack_from("<BqQ", raw, 8)
        self.docs, at = EliasFano.read(raw, 8 + struct.calcsize("<BqQ"))
        self.ends, at = EliasFano.read(raw, at)
        self.tokens = np.frombuffer(raw, f"<u{width}", -1, at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return self.docs.select(i) + self.base if i < self.docs.n else None

    def span(self, i: int) -> tuple[int, int]:
        """Where the ids of document i begin and end in the shard, by two selects."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.tokens[a:b]

    def find(self, doc_id: int) -> int | None:
        """The first document with this id, by selects in a binary search."""
        low, high = 0, self.docs.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.docs.select(mid) + self.base < doc_id else (low, mid)
        return low if low < self.docs.n and self.docs.select(low) + self.base == doc_id else None


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int = 0, shard_tokens: int = 1 << 20) -> DataFrame:
    """The written shards: part, seq, n_docs, n_tokens, image. Documents are range-partitioned by doc_id before they are encoded."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq = word_cache(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ids, size = [], [], 0

        def shard():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "image": pa.array([write_shard(doc_ids, ids)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(cache.ids(text.as_py() or "") + end)
                doc_ids.append(doc_id.as_py())
                size += len(ids[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    doc_ids, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    # equal and null ids are ranged by a hash of the text, so that many of them spread too
    order = [F.col("doc_id").asc_nulls_last(), F.col("spot")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("spot", F.xxhash64("text"))
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text")
    return staged(spark, ranged.mapInArrow(pack, "part int, seq int, n_docs long, n_tokens long, image binary"), "token-shards")


def read_tokens(shards: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32 and, with ``with_ids``, ids (little-endian unsigned 32-bit)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard, at = Shard(image), 0
                for a in range(0, len(shard), 4096):
                    out = []
                    for i in range(a, min(a + 4096, len(shard))):
                        end = shard.ends.select(i)
                        body = shard.tokens[at:end].astype("<u4").tobytes()
                        out.append((part, seq, shard.doc_id(i), at, end - at, zlib.crc32(body), body if with_ids else None))
                        at = end
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select("part", "seq", inside.alias("inside")).join(parts.select("part", "base"), "part").select("part", "seq", (F.col("inside") + F.col("base")).alias("base"))
    rows = shards.select("part", "seq", "image").mapInArrow(unpack, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    out = rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(spark, docs, tokenizer_path("byte_bpe_50k.json")), with_ids=False)
