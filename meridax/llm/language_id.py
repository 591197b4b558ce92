"""Operator 4: language identification by bit-sliced Bloom filters of n-grams.

A slot of the filter table holds a bit for each language. An n-gram has three slots; the bits that all three share are the
languages whose filter contains it, so that one lookup answers for all languages. For each text the hits of each language
are counted and corrected for false positives by the filter's fill: (hits - n * rate) / (1 - rate). The largest count wins;
the score is its share of all counts.

Fitting reads labelled rows only. ``sample_documents`` labelled texts of each language, chosen by a hash of doc_id, bound
what is gathered; texts are read whole. A language gets an n-gram that is at least ``rare`` as frequent there as where it
is most frequent. The filter has a fixed size (``slots`` times at most 8 bytes), whatever the input, and is broadcast.

Null text, and text without a letter, is ``und`` with score 0. If nothing was learned, all texts are ``und``. Without any
hit the first language by frequency is named, with score 0. Repeated rows get equal results. A null doc_id has no fold: it is
neither held out nor learned from. Extra columns are ignored. An empty table gives an empty result. At most 64 languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._bytes import U64, RangeHash, mix, portions, utf8

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32
HASHES = 3


@dataclass
class Model:
    """``table``: bits of languages by slot. ``rates``: false positives by language."""

    languages: list[str]
    gram: int
    table: np.ndarray
    rates: np.ndarray


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes + U64(k)) >> U64(64 - bits)).astype(np.int64) for k in range(HASHES)]


def _grams(texts: list[str | None], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each lower-cased text between blanks, other characters than letters as blanks; and offsets."""
    raw = [f" {(t or '').lower()} ".encode() for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    data = _SPACE[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.maximum(0, sizes - gram + 1)
    begins = np.cumsum(sizes) - sizes
    hashes = RangeHash(data).grams(gram)
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, begins, counts > 0)
    np.add.at(keep, begins + counts, -(counts > 0).astype(np.int32))
    return hashes[np.cumsum(keep)[: len(hashes)] > 0], np.concatenate([[0], np.cumsum(counts)])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(spark: SparkSession, labelled: DataFrame, *, gram: int = 5, slots: int = 1 << 23, sample_documents: int = 1500, rare: float = 0.2, least: int = 2) -> Model:
    """A model of the rows (doc_id, text, lang) of ``labelled``."""
    rows = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(65).collect()}
    languages = list(counts)
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= max(1, len(languages)))
    bits = slots.bit_length() - 1
    if not languages:
        return Model([], gram, np.zeros(1 << bits, kind), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_documents / counts[lang]))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 11) / float(1 << 53) < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 4 << 20):
            lang = batch.column(0).to_numpy()
            hashes, at = _grams(batch.column(1).to_pylist(), gram)
            of = np.repeat(lang, np.diff(at))
            for i in np.unique(lang):
                value, n = np.unique(hashes[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i), pa.int32()), pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found = chosen.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = found.persist()
    totals = {r["lang"]: float(r["n"]) for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if totals:
        total = F.create_map(*[F.lit(x) for i, n in totals.items() for x in (i, n)])
        rated = found.groupBy("gram").agg(F.collect_list(F.struct((F.col("n") / total[F.col("lang")]).alias("rate"), "lang")).alias("langs"), F.max(F.col("n") / total[F.col("lang")]).alias("top"))
        masks = rated.select("gram", F.aggregate("langs", F.lit(0).cast("long"), lambda m, x: F.when(x["rate"] >= rare * F.col("top"), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["lang"]))).otherwise(m)).alias("mask"))
    else:
        masks = spark.createDataFrame([], "gram long, mask long")
    piece = 1 << 16

    def fill(batches):
        table = None
        for batch in batches:
            table = np.zeros(1 << bits, np.uint64) if table is None else table
            mask = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
            for slot in _slots(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, slot, mask)
        if table is not None:
            for a in range(0, len(table), piece):
                if table[a : a + piece].any():
                    yield pa.RecordBatch.from_arrays([pa.array([a // piece], pa.int32()), pa.array([table[a : a + piece].astype(kind).tobytes()], pa.binary())], ["slice", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, kind) for x in table["bits"].to_pylist()])
        return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    table = np.zeros(1 << bits, kind)
    for row in masks.coalesce(8).mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInArrow(unite, "slice int, bits binary").toLocalIterator():
        table[row["slice"] * piece : (row["slice"] + 1) * piece] = np.frombuffer(row["bits"], kind)
    found.unpersist()
    fill_rate = np.array([float((table >> kind(i) & kind(1)).mean()) for i in range(len(languages))])
    return Model(languages, gram, table, fill_rate**HASHES)


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, portion_bytes: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = spark.sparkContext.broadcast(model)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits = len(m.table).bit_length() - 1
        for batch in portions(batches, "text", portion_bytes):
            texts = batch.column(1).to_pylist()
            hashes, at = _grams(texts, m.gram)
            mask = np.bitwise_and.reduce([m.table[s] for s in _slots(hashes, bits)])
            n = np.diff(at)
            counts = np.zeros((len(m.languages), len(texts)))
            for i, rate in enumerate(m.rates):
                sums = np.concatenate([[0], np.cumsum(mask >> mask.dtype.type(i) & mask.dtype.type(1), dtype=np.int64)])
                counts[i] = np.maximum(0, (sums[at[1:]] - sums[at[:-1]] - n * rate) / max(1e-9, 1 - rate))
            total = counts.sum(0)
            best = counts.argmax(0) if len(m.languages) else np.zeros(len(texts), int)
            known = [bool(m.languages) and t is not None and bool(_LETTER.search(t)) for t in texts]
            score = [float(counts[b, i] / total[i]) if k and total[i] > 0 else 0.0 for i, (b, k) in enumerate(zip(best, known))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(name, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(spark, docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
