"""Operator 1: exact substring dedup by merged shard Burrows-Wheeler transforms.

A byte goes if a ``length``-byte string covers it that also starts in a document with a smaller id.

1. Documents are packed into blocks, written once to the shared folder.
2. Sieve: each ``length``-byte window belongs to the run of windows that share its smallest 20-byte gram. Grams that
   only one document holds can't matter. Blocks send sorted gram hashes by hash range; each range answers with bit masks.
   Blocks and ranges hold 8 MB of text each: a block writes to every range, so that messages grow with the square of the
   corpus over the product of both sizes.
3. The runs whose gram two documents hold become short strings; equal strings collapse to one with the smallest id.
   Runs of a gram in very many documents are cut into single windows, dealt by the window itself, so that no gram makes
   a large group: equal windows collapse in each block, different ones scatter.
4. In each range, the strings of each gram that has several form shards. Each shard gets a suffix array and its Burrows-Wheeler transform. The shards are
   merged by interleave refinement: after round h the merged order is right for the first h characters, and the
   boundaries that round h adds have a common prefix of h - 1. No suffix of the whole is sorted again. After
   ``length`` rounds, the intervals without a boundary are the repeated strings; the smallest id in each is the answer.
   A block gets one bit for each window: whether an id smaller than the smallest of its own has it.
5. Blocks read the answers, mark the covered bytes and cut them out. Steps 3 and 5 read one shuffle of the blocks.

Null text counts as empty; empty and short texts have nothing removed. A null doc_id counts as larger than all ids.
Rows with equal ids don't remove each other's bytes. Extra columns are ignored. An empty table gives an empty result.
Hashes of 64 bits stand for grams in the sieve, where a collision only adds work, and for equal strings when they collapse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._bytes import U64, RangeHash, longs, mix, portions, ragged, utf8, windowed_min
from meridax.llm._scratch import staged

GRAM = 20
NO_ID = np.iinfo(np.int64).max


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _zip_planes(x: np.ndarray) -> bytes:
    """Numbers whose high bytes hardly differ: all first bytes, then all second ones and so on."""
    return _zip(x.view(np.uint8).reshape(len(x), -1).T)


def _unzip_planes(x: bytes, kind, columns: int = 1) -> np.ndarray:
    return np.ascontiguousarray(_unzip(x, np.uint8).reshape(np.dtype(kind).itemsize * columns, -1).T).view(kind)


def _contents(data: np.ndarray, first: np.ndarray, size: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Hashes of the strings ``data[first:first + size]``; only a piece of the data is summed at a time."""
    out = np.empty(len(first), U64)
    by = np.argsort(first, kind="stable")
    starts, a = first[by], 0
    while a < len(by):
        b = int(np.searchsorted(starts, starts[a] + piece))
        begin, end = first[by[a:b]] - starts[a], first[by[a:b]] + size[by[a:b]] - starts[a]
        out[by[a:b]] = RangeHash(data[starts[a] : starts[a] + end.max()]).of(begin, end)
        a = b
    return out


# ---------------------------------------------------------------- shard transforms and their merge


def shard_transform(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, Burrows-Wheeler transform and last-to-first map of the strings ``data[at[i]:at[i+1]]``.

    Characters are bytes plus 1; 0 ends each string, and ends are ordered by string. Positions count the ends too:
    string i lies at ``at[i] + i``. UTF-8 has no byte 255, so a character fits a byte.
    """
    m = len(at) - 1
    lengths = np.diff(at)
    n = len(data) + m
    text = np.zeros(n + 16, np.uint8)
    base = at[:-1] + np.arange(m)
    text[ragged(base, lengths)] = data + 1
    ends = at[1:] + np.arange(m)
    string = np.repeat(np.arange(m), lengths + 1)
    left = ends[string] - np.arange(n)  # characters before the end
    word = np.zeros(n, U64)
    for j in range(8):
        part = text[j : j + n].astype(U64)
        part[left < j] = 0
        word |= part << U64(56 - 8 * j)
    order = np.argsort(word, kind="stable")
    settled = left[order] < 8
    fresh = np.ones(n, bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | settled[1:] | settled[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    reach = 8
    while not fresh.all():
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        where = np.flatnonzero(tied)
        now = order[where]
        key = rank[now].astype(U64) * U64(n + 1) + rank[np.minimum(now + reach, n - 1)].astype(U64)
        by = np.argsort(key, kind="stable")
        order[where] = now[by]
        key = key[by]
        fresh[where] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        reach *= 2
    previous = order - 1
    begins = np.zeros(n, bool)
    begins[base] = True
    last = np.where(begins[order], 0, text[previous]).astype(np.uint8)
    first = np.argsort(last, kind="stable")
    step = np.empty(n, np.int32)
    step[first] = np.arange(n, dtype=np.int32)
    return order, last, step


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' transforms, refined ``depth`` times.

    Returns the merged order, as numbers into the concatenated shard orders, and for each place the common prefix with
    the place before it: exact below ``depth``, else ``depth``.
    """
    sizes = np.array([len(s[0]) for s in shards])
    offset = np.cumsum(sizes) - sizes
    last = np.concatenate([s[1] for s in shards])
    step = np.concatenate([s[2] + np.int32(o) for s, o in zip(shards, offset)])
    ends = np.concatenate([np.arange(k, dtype=np.int32) + np.int32(o) for k, o in zip(strings, offset)])
    n, m = len(last), len(ends)
    merged = np.arange(n, dtype=np.int32)
    group = np.zeros(n, np.int32)
    prefix = np.zeros(n, np.int16)
    fresh = np.ones(n, bool)
    for _ in range(depth):
        by = last[merged]
        turn = np.argsort(by, kind="stable")
        by, old = by[turn], group[turn]
        merged = step[merged[turn]]
        merged[:m] = ends
        fresh[1:] = (by[1:] != by[:-1]) | (old[1:] != old[:-1])
        fresh[: m + 1] = True
        prefix += ~fresh  # a boundary, once there, stays
        np.cumsum(fresh, out=group)
    return merged, prefix


def smallest_by_window(data: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int, shard_bytes: int = 1 << 16) -> np.ndarray:
    """For each byte of the given strings at which ``length`` bytes start: the smallest id of a string with the same bytes anywhere (elsewhere: no meaning)."""
    m = len(at) - 1
    cuts = _cuts(at, shard_bytes)
    shards = [shard_transform(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in zip(cuts, cuts[1:])]
    merged, prefix = merged_intervals(shards, [b - a for a, b in zip(cuts, cuts[1:])], length)
    place = np.concatenate([s[0] + (at[a] + a) for s, a in zip(shards, cuts)])[merged]
    owner = np.repeat(np.arange(m), np.diff(at) + 1)[place]
    begins = np.flatnonzero(prefix < length)
    least = np.minimum.reduceat(ids[owner], begins)
    out = np.empty(len(data) + m, np.int64)
    out[place] = np.repeat(least, np.diff(np.append(begins, len(place))))
    return out[ragged(at[:-1] + np.arange(m), np.diff(at))]


def _cuts(at: np.ndarray, size: int, together: np.ndarray | None = None) -> list[int]:
    """Where to cut strings at offsets ``at`` into batches of about ``size`` bytes; ``together``: equal neighbours stay in one batch."""
    cuts, n = [0], len(at) - 1
    while cuts[-1] < n:
        cut = max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + size, "right")) - 1)
        if together is not None and cut < n:
            cut = int(np.searchsorted(together, together[cut - 1], "right"))
        cuts.append(cut)
    return cuts


# ---------------------------------------------------------------- blocks and their runs


class Runs:
    """The runs of windows with one smallest gram, over all documents of a block."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, portion: int = 1 << 18):
        self.data, self.at, self.length = data, at, length
        parts = []
        lengths = np.diff(at)
        doc, n = 0, len(lengths)
        while doc < n:
            if lengths[doc] > portion:  # a very long text: pieces that overlap, so that each window lies in one
                for a in range(int(at[doc]), int(at[doc + 1]) - length + 1, portion):
                    parts.append(self._of(a, min(a + portion + length - 1, int(at[doc + 1])), np.array([a, at[doc + 1]])))
                doc += 1
            else:
                to = max(doc + 1, int(np.searchsorted(at, at[doc] + portion, "right")) - 1)
                parts.append(self._of(int(at[doc]), int(at[to]), at[doc : to + 1]))
                doc = to
        self.gram, self.start, self.end = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate((U64, np.int64, np.int64)))
        self.doc = np.searchsorted(at, self.start, "right") - 1

    def _of(self, a: int, b: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows inside data[a:b]: gram hash, first window, past the last window."""
        if b - a < self.length:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = windowed_min(RangeHash(self.data[a:b]).grams(GRAM), self.length - GRAM + 1)
        edges = np.clip(edges - a, 0, b - a)
        ok = np.zeros(len(least) + 1, np.int32)  # windows that lie in one document
        firsts, lasts = edges[:-1], edges[1:] - self.length + 1
        keep = lasts > firsts
        np.add.at(ok, firsts[keep], 1)
        np.add.at(ok, np.minimum(lasts[keep], len(least)), -1)
        inside = np.cumsum(ok[:-1]) > 0
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        change[firsts[firsts < len(least)]] = True
        begins = np.flatnonzero(change)
        ends = np.append(begins[1:], len(least))
        keep = inside[begins]
        return mix(least[begins[keep]]), begins[keep] + a, ends[keep] + a  # mixed anew: minima are small, and ranges are to be even

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The different grams in order, and for each the number of documents with it."""
        order = np.argsort(self.gram, kind="stable")
        gram, doc = self.gram[order], self.doc[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = gram[1:] != gram[:-1]
        other = fresh.copy()
        other[1:] |= doc[1:] != doc[:-1]
        begins = np.flatnonzero(fresh)
        return gram[begins], np.add.reduceat(other.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)

    def strings(self, shared: np.ndarray, hot: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """The strings of shared grams: key, place, size and document of each, and the different ones among them, by key."""
        grams, _ = self.grams()
        number = np.searchsorted(grams, self.gram)
        keep = shared[number]
        gram, start, end, heat = self.gram[keep], self.start[keep], self.end[keep], hot[number][keep]
        windows = end - start
        single = ragged(start[heat], windows[heat])
        first = np.concatenate([start[~heat], single])
        size = np.concatenate([windows[~heat], np.ones(len(single), np.int64)]) + self.length - 1
        content = _contents(self.data, first, size)
        key = np.concatenate([gram[~heat], mix(content[len(start) - int(heat.sum()) :] ^ U64(0x5851F42D4C957F2D))])
        doc = np.searchsorted(self.at, first, "right") - 1
        order = np.lexsort((ids[doc], content, key))
        key, content, first, size, doc = (x[order] for x in (key, content, first, size, doc))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        return {"key": key, "first": first, "size": size, "doc": doc, "fresh": np.flatnonzero(fresh), "number": np.cumsum(fresh) - 1}


def _slices(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ranges`` equal ranges of 64-bit keys occur in the ordered keys, and where each begins (one more value)."""
    part = (keys >> U64(32)) * U64(ranges) >> U64(32)
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[begins].astype(np.int64), np.append(begins, len(part))


def _short(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Of each hash, 32 bits below those that number its range: about one of 10,000 meets another in a range of 8 MB, which only adds work."""
    return (hashes >> U64(32 - (min(ranges, 1 << 32).bit_length() - 1))).astype("<u4")


_BLOCK = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary()), ("more", pa.binary()), ("ids", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    return np.frombuffer(zstandard.decompress(row["body"]), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(row["ids"], np.int64)


def suffix_dedup(spark: SparkSession, docs: DataFrame, *, length: int = 50, block_bytes: int = 1 << 23, range_bytes: int = 1 << 23, hot_documents: int = 2000, batch_bytes: int = 1 << 17, with_kept: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_kept``, the remaining bytes ``kept``.

    ``block_bytes`` and ``range_bytes``: text per block and per hash range, which bound what a task holds; messages
    number (all text) ** 2 / (block_bytes * range_bytes). ``hot_documents``: grams in more documents are dealt window by
    window. ``batch_bytes``: what is merged at once. None of these changes a result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in portions(batches, "text", block_bytes):
            data, at = utf8(batch.column(1))
            yield _rows(_BLOCK, [number], [len(data)], [longs(batch.column(0)).tobytes()], [np.diff(at).tobytes()], [zstandard.compress(data.tobytes(), 1)])
            number += 1

    blocks = staged(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, _ddl(_BLOCK)), "dedup-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(16, min(1 << 30, total // range_bytes))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            data, at, _ = _open(row)
            grams, documents = Runs(data, at, length).grams()
            parts, edges = _slices(grams, ranges)
            documents = np.minimum(documents, 65535).astype(np.uint16)
            short = _short(grams, ranges)
            yield _rows(_SENT, parts, [row["block"]] * len(parts), [short[a:b].tobytes() for a, b in zip(edges, edges[1:])], [_zip(documents[a:b]) for a, b in zip(edges, edges[1:])], [None] * len(parts))

    def shared(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u4") for x in table["body"].to_pylist()]
        counts = [_unzip(x, np.uint16) for x in table["more"].to_pylist()]
        every, weight = np.concatenate(sent), np.concatenate(counts).astype(np.int64)
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        held = np.add.reduceat(weight, begins)
        level = np.empty(len(every), np.uint8)
        level[order] = np.repeat((held > 1).astype(np.uint8) + (held > hot_documents), np.diff(np.append(begins, len(every))))
        edges = np.cumsum([0, *map(len, sent)])
        body = [_zip(level[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table([table["block"].cast(pa.int64()), table["part"].cast(pa.int32()), pa.array(body, pa.binary())], schema=_TOLD)

    def with_answers(told: DataFrame) -> DataFrame:
        return blocks.join(told.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("told")), "block", "left")

    def levels(told: list[dict] | None) -> np.ndarray:
        parts = [_unzip(x["body"], np.uint8) for x in sorted(told or [], key=lambda x: x["part"])]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    masks = staged(spark, blocks.mapInArrow(sieve, _ddl(_SENT)).groupBy("part").applyInArrow(shared, _ddl(_TOLD)), "dedup-masks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            data, at, ids = _open(row)
            level = levels(row["told"])
            if not level.any():
                continue
            s = Runs(data, at, length).strings(level > 0, level > 1, ids)
            key, first, size, least = s["key"][s["fresh"]], s["first"][s["fresh"]], s["size"][s["fresh"]], ids[s["doc"][s["fresh"]]]
            parts, edges = _slices(key, ranges)
            about = np.stack([size.astype("<u4"), _short(key, ranges)], 1)
            bodies = [_zip(data[ragged(first[a:b], size[a:b])]) for a, b in zip(edges, edges[1:])]
            yield _rows(_SENT, parts, [row["block"]] * len(parts), bodies, [_zip_planes(about[a:b]) for a, b in zip(edges, edges[1:])], [_zip_planes(least[a:b]) for a, b in zip(edges, edges[1:])])

    def merge(table: pa.Table) -> pa.Table:
        about = [_unzip_planes(x, "<u4", 2) for x in table["more"].to_pylist()]
        data = np.concatenate([_unzip(x, np.uint8) for x in table["body"].to_pylist()])
        size, key = (np.concatenate([x[:, i] for x in about]).astype(np.int64) for i in range(2))
        ids = np.concatenate([_unzip_planes(x, np.int64).ravel() for x in table["ids"].to_pylist()])
        at = np.concatenate([[0], np.cumsum(size)])
        windows = size - length + 1
        content = _contents(data, at[:-1], size)
        order = np.lexsort((ids, content))
        fresh = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        chosen = order[fresh]  # of equal strings one stays, with the smallest id
        own = np.concatenate([[0], np.cumsum(windows[chosen])])
        _, group, members = np.unique(key[chosen], return_inverse=True, return_counts=True)
        least = np.repeat(ids[chosen], windows[chosen])  # right for the only string of its gram
        several = np.flatnonzero(members[group] > 1)
        several = several[np.argsort(group[several], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(size[chosen[several]])])
        cuts = _cuts(ends, batch_bytes, group[several]) if len(several) else [0]
        for a, b in zip(cuts, cuts[1:]):  # a gram's strings stay together
            some, row = several[a:b], chosen[several[a:b]]
            text = data[ragged(at[row], size[row])]
            found = smallest_by_window(text, ends[a : b + 1] - ends[a], ids[row], length)
            least[ragged(own[some], windows[row])] = found[ragged(ends[a:b] - ends[a], windows[row])]
        edges = np.cumsum([0, *map(len, about)])
        body = [_zip(least[ragged(own[number[a:b]], windows[a:b])] < np.repeat(ids[a:b], windows[a:b])) for a, b in zip(edges, edges[1:])]
        return pa.table([table["block"].cast(pa.int64()), table["part"].cast(pa.int32()), pa.array(body, pa.binary())], schema=_TOLD)

    # not staged in between: the blocks are dealt once for both joins
    answers = with_answers(masks).mapInArrow(send, _ddl(_SENT)).groupBy("part").applyInArrow(merge, _ddl(_TOLD))
    both = with_answers(masks).withColumnRenamed("told", "levels").join(answers.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("told")), "block", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            data, at, ids = _open(row)
            gone = np.zeros(len(data), bool)  # windows that go, by their starts
            if row["told"]:
                level = levels(row["levels"])
                s = Runs(data, at, length).strings(level > 0, level > 1, ids)
                smaller = levels(row["told"]).view(bool)
                windows = s["size"] - length + 1
                base = np.cumsum(windows[s["fresh"]]) - windows[s["fresh"]]
                own = ids[s["doc"]]
                later = own > own[s["fresh"]][s["number"]]  # a smaller id of this block has the whole string
                for a in range(0, len(windows), 1 << 14):
                    some, n = s["number"][a : a + (1 << 14)], windows[a : a + (1 << 14)]
                    hit = smaller[ragged(base[some], n)] | np.repeat(later[a : a + (1 << 14)], n)
                    gone[ragged(s["first"][a : a + (1 << 14)], n)[hit]] = True
            before = np.concatenate([[0], np.cumsum(gone)]).astype(np.int32)
            covered = before[1:] > 0
            covered[length - 1 :] = before[length:] > before[:-length]
            rise = covered.copy()
            rise[1:] &= ~covered[:-1]
            rise[at[:-1][at[:-1] < len(data)]] = covered[at[:-1][at[:-1] < len(data)]]
            removed, spans = (np.concatenate([[0], np.cumsum(x)])[at] for x in (covered, rise))
            kept = [data[a:b].tobytes() if not r else data[a:b][~covered[a:b]].tobytes() for a, b, r in zip(at, at[1:], np.diff(removed))]
            yield _rows(_OUT, [None if i == NO_ID else int(i) for i in ids], np.diff(at), np.diff(removed), np.diff(spans), [hashlib.sha256(x).hexdigest() for x in kept], kept if with_kept else [None] * len(ids))

    out = both.mapInArrow(cut, _ddl(_OUT))
    return out if with_kept else out.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
