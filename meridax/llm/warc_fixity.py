"""Operator 5: Merkle fixity audit of WARC replicas.

Pages are written as WARC files (response records, in order of page_id), with an index of offset ranges. For a replica each
range is hashed, and hashes of ordered ranges are hashed again, ``FANOUT`` at a time, up to one root for each file and one
for the archive. An audit compares roots and descends only below nodes that differ, level by level, so that a sound
replica costs one comparison and a damaged record a path of them. A leaf's hash covers its offset, length and bytes.

Null url and html count as empty, a null page_id is written as -1; line breaks in a url are percent-encoded. Repeated rows are
records of their own. Extra columns are ignored. Records and files that one replica lacks or adds are found too. Empty tables give an empty archive, index and audit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._scratch import staged

FANOUT, LEVELS = 16, 6  # 16**6 records a file
_FILE = "file string, image binary, offsets binary, page_ids binary"


def warc_record(page_id: int, url: str, html: str) -> bytes:
    """One response record of WARC 1.1; its id derives from its number and body, so that runs agree."""
    body = html.encode()
    url = url.replace("\r", "%0D").replace("\n", "%0A")  # a line break would end the header
    name = hashlib.md5(struct.pack("<q", page_id) + body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:md5:{name}>\r\nX-Page-ID: {page_id}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def read_warc(image: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, body) of each record."""
    at = 0
    while at < len(image):
        end = image.index(b"\r\n\r\n", at) + 4
        lines = image[at : end - 4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, end - at + size + 4, headers, image[end : end + size]
        at = end + size + 4


def write_archive(spark: SparkSession, pages: DataFrame, *, file_records: int = FANOUT**3, file_bytes: int = 4 << 20) -> DataFrame:
    """The written WARC files with their index: ordered offsets (one more than records) and page ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, records, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def done():
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in records])]).astype("<i8")
            return pa.RecordBatch.from_pydict({"file": [f"{part:06d}-{seq:06d}.warc"], "image": [b"".join(records)], "offsets": [offsets.tobytes()], "page_ids": [np.array(ids, "<i8").tobytes()]})

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(-1 if page_id is None else page_id)
                records.append(warc_record(ids[-1], url or "", html or ""))
                size += len(records[-1])
                if len(records) >= file_records or size >= file_bytes:
                    yield done()
                    records, ids, size, seq = [], [], 0, seq + 1
        if records:
            yield done()

    order = [F.col("page_id").asc_nulls_last(), "url", "html"]
    ranged = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return staged(spark, ranged.mapInArrow(pack, _FILE), "warc")


def _above(sums: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"\x01" + b"".join(sums[i : i + FANOUT])).digest() for i in range(0, len(sums), FANOUT)]


def tree_nodes(archive: DataFrame) -> DataFrame:
    """(file, level, node, offset, length, page_id, hash): the hashed ranges of a replica by its index, at level 0, and all levels above them up to ``LEVELS``, in one pass."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, image, offsets, page_ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at, ids = np.frombuffer(offsets, "<i8"), np.frombuffer(page_ids, "<i8")
                view = memoryview(image.as_buffer())
                sums = [hashlib.sha256(struct.pack("<cqq", b"\x00", a, b - a) + view[a:b]).digest() for a, b in zip(at.tolist(), at[1:].tolist())]
                level, columns = 0, [at[:-1], np.diff(at), ids]
                while sums:
                    n = len(sums)
                    about = [pa.array(x) if level == 0 else pa.nulls(n, pa.int64()) for x in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, level, np.int32)), pa.array(np.arange(n, dtype=np.int64)), *about, pa.array([x.hex() for x in sums])], ["file", "level", "node", "offset", "length", "page_id", "hash"])
                    if level == LEVELS:
                        if n > 1:
                            raise ValueError(f"{file} has more than {FANOUT**LEVELS} records")
                        break
                    level, sums = level + 1, _above(sums)

    return archive.select("file", "image", "offsets", "page_ids").mapInArrow(hashed, "file string, level int, node long, offset long, length long, page_id long, hash string")


class Tree:
    """A replica's tree, each level staged once: within files by groups of ``FANOUT``, always ``LEVELS`` levels, then over files by prefixes of their hashed names.

    Levels and prefixes are absolute, so that replicas of different sizes and with different files still align.
    """

    def __init__(self, spark: SparkSession, archive: DataFrame):
        self.spark, self.nodes = spark, staged(spark, tree_nodes(archive), "merkle-nodes")
        self.files = staged(spark, self.nodes.where(f"level = {LEVELS}").select("file", "hash"), "merkle-files")
        self.leaves = self.nodes.where("level = 0").drop("level")
        files, most = self.files.count(), self.nodes.where("level = 0").agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
        self.depth = self.digits = 0  # the levels that hold more than a node a file, and the prefixes that tell files apart
        while most > 0:
            self.depth, most = self.depth + 1, most // FANOUT
        while FANOUT**self.digits < files:
            self.digits += 1

    def over(self, digits: int) -> list[DataFrame]:
        """(group, hash) for the prefixes of 0 to ``digits`` hexadecimal digits, each from the level below it."""
        below = self.files.select(F.substring(F.md5("file"), 1, digits).alias("group"), F.md5("file").alias("key"), F.concat("file", "hash").alias("part"))
        out: list[DataFrame] = []
        for d in range(digits, -1, -1):
            joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("key", "part"))), lambda x: x["part"]))
            out.append(staged(self.spark, below.groupBy("group").agg(F.sha2(F.concat(F.lit("\x01"), joined), 256).alias("hash")), "merkle-over"))
            below = out[-1].select(F.substring("group", 1, max(0, d - 1)).alias("group"), F.col("group").alias("key"), F.concat("group", "hash").alias("part"))
        return out[::-1]


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    both = a.select(*keys, F.col("hash").alias("left")).join(b.select(*keys, F.col("hash").alias("right")), keys, "full_outer")
    return both.where("not (left <=> right)").select(*keys)


def audit(primary: Tree, replica: Tree) -> DataFrame:
    """(file, node) of the records that differ: roots first, then only the children of nodes that differ, a staged level at a time."""
    spark, depth, digits = primary.spark, max(primary.depth, replica.depth), max(primary.digits, replica.digits)
    at = None
    for d, sides in enumerate(zip(primary.over(digits), replica.over(digits))):
        if at is not None:
            above = at.withColumnRenamed("group", "above")
            sides = [x.join(above, F.substring(x["group"], 1, d - 1) == above["above"], "left_semi") for x in sides]
        at = staged(spark, _differing(*sides, ["group"]), "merkle-differing")
        if at.isEmpty():  # a sound replica ends at the roots
            return primary.leaves.where("false").select("file", "node")
    prefix = at.withColumnRenamed("group", "above")
    sides = [t.files.join(prefix, F.substring(F.md5(t.files["file"]), 1, digits) == prefix["above"], "left_semi") for t in (primary, replica)]
    at = staged(spark, _differing(*sides, ["file"]).withColumn("node", F.lit(0).cast("long")), "merkle-differing")
    for level in range(depth - 1, -1, -1):
        above = at.select(F.col("file").alias("in_file"), F.col("node").alias("above"))
        sides = []
        for t in (primary, replica):
            x = t.nodes.where(F.col("level") == level)
            sides.append(x.join(above, (x["file"] == above["in_file"]) & (F.floor(x["node"] / FANOUT) == above["above"]), "left_semi"))
        at = staged(spark, _differing(*sides, ["file", "node"]), "merkle-differing")
    return at


def damaged(spark: SparkSession, archive: DataFrame, one_in: int = 101) -> DataFrame:
    """A replica with one byte flipped in the middle of each record whose crc32 of ``file:number`` is a multiple of ``one_in``: a rehearsal of loss on storage."""

    def harm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for file, image, offsets in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body, at = bytearray(image), np.frombuffer(offsets, "<i8").tolist()
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    if zlib.crc32(f"{file}:{k}".encode()) % one_in == 0:
                        body[(a + b) // 2] ^= 1
                images.append(bytes(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary()), batch.column(2), batch.column(3)], ["file", "image", "offsets", "page_ids"])

    return staged(spark, archive.select("file", "image", "offsets", "page_ids").mapInArrow(harm, _FILE), "warc-replica")


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the archive of ``pages``, each with whether the audit of a rehearsed replica found it damaged."""
    archive = write_archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    tree = Tree(spark, archive)
    found = audit(tree, Tree(spark, damaged(spark, archive))).withColumn("damaged", F.lit(True))
    return tree.leaves.join(found, ["file", "node"], "left").select("page_id", "file", F.col("node").alias("record"), "offset", "length", F.col("hash").alias("leaf_sha256"), F.coalesce("damaged", F.lit(False)).alias("damaged"))
