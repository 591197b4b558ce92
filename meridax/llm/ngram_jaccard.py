"""Operator 9: exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

1. Each text gives the set of hashes of its word n-grams. Equal sets collapse to one node. Each node gets a bitmap that
   holds for each hash value whether an odd number of its n-grams has it. All sets feed one table of counts by hash,
   fixed in size, which tells common n-grams from rare ones.
2. A set of n n-grams sends its n - ceil(t n) + 1 rarest ones, in one order for all sets, so that two linked sets share
   one of those. N-grams that one node alone has sent end there.
3. Sizes form bands that grow by 1 / t. A tile holds the nodes that sent one n-gram and lie in two neighbouring bands, so
   each pair that can link meets in a tile. In a tile, the bits in which two bitmaps differ are at most the n-grams in
   which the sets differ, which bounds the overlap from above. Pairs within the bound are intersected as sorted arrays.
4. First, a node is paired in each tile with the smallest one before it within the bound only, and of these pairs the few that most
   tiles give are tested. Small tiles list all their pairs within the bound in the same pass and end there; later steps take these from the list. Then up to two rounds test a few pairs of each node with nodes that aren't connected to it yet, by a hash that
   differs by round. The links connect most of what links at all; a large group of near copies costs a few pairs a node.
   Tiles without a pair within the bound end after the first pass.
5. Then the tiles whose nodes aren't all connected yet give all pairs within the bound whose ends are not connected. In
   a tile those outside its largest connected part meet all others, in chunks if there are many. Links of both steps give the classes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Fewer words than n count as one n-gram. Null or empty text, or
text without words, has no n-grams and links with nothing. Equal ids and rows each keep their row. A null doc_id is larger
than all ids. Extra columns are ignored. An empty table gives an empty result. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._bytes import U64, longs, mix, portions, utf8, word_hashes
from meridax.llm._scratch import discard, staged
from meridax.llm.components import components

NO_ID = np.iinfo(np.int64).max
SKETCH, SLICE = 21, 1 << 16  # counts by hash: 2**21 of them, sent in slices
ASKED, PART = 24, 1 << 18  # a bitmap of 2**24 keys of texts that are asked for, made in parts
TRIES, ROUNDS = 4, 2  # so many pairs of a node are tested in a round, before all pairs that are left
FEW = 64  # tiles up to this size are compared all at once
LISTED = 16  # of tiles up to this size the first pass gives all pairs within the bound
LEAST_BITS, MOST_BITS = 1 << 7, 1 << 15


def ngram_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the ordered different hashes of its word n-grams."""
    hashes, of = word_hashes(data, at)
    grams = np.zeros(max(0, len(hashes) - words + 1), U64)
    for j in range(words):
        grams = mix(grams + hashes[j : j + len(grams)])
    out = []
    for a, b in zip(of, of[1:]):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = np.array([b - a], U64)
            for h in hashes[a:b]:
                short = mix((short + h) * U64(3))
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out


def _key(grams: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit number."""
    spread = mix(grams ^ U64(0x2545F4914F6CDD1D))
    return int(mix(np.array([spread.sum() + U64(len(grams))], U64)).view(np.int64)[0])


def band_edges(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band: sets whose sizes have a ratio of num / den or more lie in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    return np.array(edges)


def bitmap(grams: np.ndarray, share: float) -> bytes:
    """A bitmap of at least ``share`` times as many bits as n-grams, within limits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, int(share * len(grams))) - 1).bit_length()))
    odd = np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def rarity(counts: np.ndarray) -> np.ndarray:
    """Levels of n-grams by the counts of their hashes, four for each doubling."""
    return np.minimum(127, np.floor(4 * np.log2(1.0 + counts))).astype(np.uint8)


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams >> U64(20)) & U64((1 << SKETCH) - 1)).astype(np.int64)


def prefixes(sets: list[np.ndarray], levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest n - ceil(t n) + 1 n-grams of each set: the n-grams and the number of their set."""
    size = np.array([len(x) for x in sets], np.int64)
    if not size.sum():
        return np.zeros(0, U64), np.zeros(0, np.int64)
    grams, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    rank = (levels[_slot(grams)].astype(U64) << U64(57)) | (grams >> U64(7))
    order = np.lexsort((rank, of))
    place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
    keep = place < (size - -(-num * size // den) + 1)[of]
    return grams[order][keep], of[keep]


class Tiles:
    """Rows in order of tile and size, with the bitmaps of each tile folded to its smallest width."""

    def __init__(self, tile: np.ndarray, n: np.ndarray, bitmaps: pa.Array, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(tile)))
        self.tile = np.repeat(np.arange(len(self.starts)), self.sizes)
        raw, at = utf8(bitmaps)
        own = np.diff(at) // 8
        least = np.minimum.reduceat(own, self.starts)[self.tile] if len(tile) else own
        self.width, self.spot = least, np.zeros(len(tile), np.int64)
        self.words: dict[int, np.ndarray] = {}
        wide = np.frombuffer(np.ascontiguousarray(raw).tobytes(), U64)
        for w in np.unique(least).tolist():
            rows = np.flatnonzero(least == w)
            self.spot[rows] = np.arange(len(rows))
            folded = np.empty((len(rows), w), U64)
            for o in np.unique(own[rows]).tolist():
                some = np.flatnonzero(own[rows] == o)
                cells = wide[(at[:-1][rows[some]] // 8)[:, None] + np.arange(o)]
                folded[some] = np.bitwise_xor.reduce(cells.reshape(len(some), o // w, w), axis=1)
            self.words[w] = folded

    def within(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs, i before j in one tile, can link by their sizes and bitmaps."""
        a, b = self.n[i], self.n[j]
        out = a * self.den >= b * self.num
        rows = np.flatnonzero(out)
        both, width = (a + b)[rows], self.width[i[rows]]
        for w, words in self.words.items():
            own = np.flatnonzero(width == w)
            for c in range(0, len(own), 1 << 16):
                some = own[c : c + (1 << 16)]
                x, y = self.spot[i[rows[some]]], self.spot[j[rows[some]]]
                differ = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64)
                bound = (both[some] - differ) // 2
                out[rows[some]] = (self.den + self.num) * bound >= self.num * both[some]
        return out

    def first_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row with the first one before it in its tile within the bound, in tiles above ``LISTED`` (kind 0) and up to it (1), there with all other pairs within the bound (2)."""
        found = [np.zeros((3, 0), np.int64)]
        listed = self.sizes[self.tile] <= LISTED if len(self.tile) else np.zeros(0, bool)
        small = np.flatnonzero((self.sizes[self.tile] <= FEW) if len(self.tile) else [])
        first = np.full(len(self.tile), -1)
        for k in range(int(self.sizes[self.sizes <= FEW].max(initial=1)) - 1, 0, -1):  # the farthest first, so that the nearest to the start stays last
            i = small[:-k][self.tile[small[:-k]] == self.tile[small[k:]]]
            i = i[listed[i] | (first[i + k] < 0)]
            i = i[self.within(i, i + k)]
            other = first[i + k] >= 0
            found.append(np.stack([i[other], i[other] + k, np.full(int(other.sum()), 2)]))
            i = i[~other]
            first[i + k] = i
        j = np.flatnonzero(first >= 0)
        found.append(np.stack([first[j], j, listed[j]]))
        for a, m in zip(self.starts[self.sizes > FEW].tolist(), self.sizes[self.sizes > FEW].tolist()):
            left = np.arange(a + 1, a + m)
            for i in range(a, a + m - 1):
                left = left[left > i] if len(left) and left[0] <= i else left
                if not len(left):
                    break
                hit = self.within(np.full(len(left), i), left)
                found.append(np.stack([np.full(int(hit.sum()), i), left[hit], np.zeros(int(hit.sum()), np.int64)]))
                left = left[~hit]
        return tuple(np.concatenate(found, 1))

    def all_pairs(self, label: np.ndarray, few: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within the bound whose labels differ, of rows of which one is marked in ``few``."""
        small = np.flatnonzero((self.sizes[self.tile] <= FEW) if len(self.tile) else [])
        for k in range(1, int(self.sizes[self.sizes <= FEW].max(initial=1))):
            i = small[:-k][self.tile[small[:-k]] == self.tile[small[k:]]]
            i = i[(label[i] != label[i + k]) & (few[i] | few[i + k])]
            i = i[self.within(i, i + k)]
            yield i, i + k
        for a, m in zip(self.starts[self.sizes > FEW].tolist(), self.sizes[self.sizes > FEW].tolist()):
            own = np.arange(a, a + m)
            for r in own[few[own]]:
                others = own[(label[own] != label[r]) & (~few[own] | (own > r))]
                i, j = np.minimum(r, others), np.maximum(r, others)
                hit = self.within(i, j)
                yield i[hit], j[hit]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ordered sets link, by their exact intersection."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    overlap = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return overlap > 0 and den * overlap >= num * (len(a) + len(b) - overlap)


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _aligned(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most: int | None) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Batches cut between tiles, with a number for each row's tile. Tiles above ``most`` rows come in parts of that size."""

    def numbered(table):
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        tile = numbered(table)
        cut = int(np.searchsorted(tile, tile[-1]))
        if most and table.num_rows - cut >= most:
            cut = table.num_rows
        if cut:
            yield tile[:cut], table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        if table.num_rows:
            yield numbered(table), table


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def ngram_classes(spark: SparkSession, docs: DataFrame, **limits: int) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of Jaccard similarity num / den or more."""
    return classed_texts(spark, docs, **limits).select("doc_id", "n_shingles", "component_id")


def text_key(text: Column) -> Column:
    """Names a text among the rows of one doc_id."""
    return F.xxhash64(text.cast("string"))


class Join:
    """The steps of one join. ``portion_bytes``: text handled at once; ``tile_rows``: rows of a tile handled at once, above which it is cut into chunks; ``job_ngrams``: n-grams that meet one set in one job. None of them changes a result."""

    def __init__(self, spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, portion_bytes: int = 2 << 20, tile_rows: int = 4096, job_ngrams: int = 1 << 20):
        self.spark, self.words, self.num, self.den = spark, words, num, den
        self.portion_bytes, self.tile_rows, self.job_ngrams = portion_bytes, tile_rows, job_ngrams
        self.texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key(F.col("text")))

    def sets_of(self):
        words, portion_bytes = self.words, self.portion_bytes

        def read(batches: Iterator[pa.RecordBatch]):
            for batch in portions(batches, "text", portion_bytes):
                yield batch, ngram_sets(*utf8(batch.column(batch.schema.get_field_index("text"))), words)

        return read

    def describe(self) -> DataFrame:
        """Kind 0, a row of the input: doc_id, text_key, n, node, body (its bitmap). Kind 1: a slice of a task's counts."""
        sets_of, names = self.sets_of(), ["kind", "doc_id", "text_key", "n", "node", "body"]
        share = 5 * (self.den - self.num) / self.den  # unlike sets differ in half the bits, linked ones in about 2 (1 - t) / (1 + t) of their n-grams

        def run(batches):
            counts, seen = np.zeros(1 << SKETCH, np.int64), set()
            for batch, sets in sets_of(batches):
                keys = [_key(x) for x in sets]
                fresh = [x for k, x in zip(keys, sets) if k not in seen and not seen.add(k) and len(x)]
                if fresh:
                    counts += np.bincount(_slot(np.concatenate(fresh)), minlength=1 << SKETCH)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column(0), batch.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([bitmap(x, share) if len(x) else None for x in sets], pa.binary())], names)
            if counts.any():
                parts = [zstandard.compress(counts[a : a + SLICE].astype("<u4").tobytes(), 1) for a in range(0, 1 << SKETCH, SLICE)]
                none = pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), none, none, none, pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], names)

        return staged(self.spark, self.texts.select("doc_id", "text", "text_key").mapInArrow(run, "kind int, doc_id long, text_key long, n long, node long, body binary"), "ngram-docs")

    def levels(self, about: DataFrame) -> np.ndarray:
        """The rarity of each hash, from the counts of all tasks: a table of fixed size, a byte for each hash."""

        def unite(table: pa.Table) -> pa.Table:
            total = np.zeros(SLICE, np.uint64)
            for x in table["body"].to_pylist():
                total += np.frombuffer(zstandard.decompress(x), "<u4")
            return pa.table({"node": table["node"][:1], "body": pa.array([rarity(total).tobytes()], pa.binary())})

        levels = rarity(np.zeros(1 << SKETCH, np.uint64))
        for row in about.where("kind = 1").select("node", "body").groupBy("node").applyInArrow(unite, "node long, body binary").collect():
            levels[row["node"] * SLICE : (row["node"] + 1) * SLICE] = np.frombuffer(row["body"], np.uint8)
        return levels

    def shared(self, levels: np.ndarray) -> DataFrame:
        """(tile, node, n): the nodes that meet others in a tile. Rows without a node name the tiles of more than ``tile_rows``."""
        sets_of, num, den, most = self.sets_of(), self.num, self.den, self.tile_rows
        table = self.spark.sparkContext.broadcast(levels)
        least, edges = num // (den - num), band_edges(num, den)  # smaller sets link with equal ones only

        def send(batches):
            seen = set()
            for _, sets in sets_of(batches):
                keyed = {k: x for k, x in ((_key(x), x) for x in sets if len(x) >= max(2, least)) if k not in seen}
                seen.update(keyed)
                gram, of = prefixes(list(keyed.values()), table.value, num, den)
                if len(gram):
                    node, n = np.array(list(keyed), np.int64), np.array([len(x) for x in keyed.values()], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(node[of]), pa.array(n[of])], ["gram", "node", "n"])

        def meet(batches):
            """Rows come in order of n-gram, size and node; a batch's last row waits for the next batch."""
            last, before, counts = None, False, {}
            for batch in chain(batches, [None]):
                if batch is not None:
                    gram, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                    if last is not None:
                        gram, node, n = (np.concatenate([[x], y]) for x, y in zip(last, (gram, node, n)))
                    if not len(gram):
                        continue
                elif last is None:
                    return
                else:
                    gram, node, n = (np.array([x]) for x in last)
                fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
                gram, node, n = (x[fresh] for x in (gram, node, n))
                band = np.searchsorted(edges, n, "right") - 1
                group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])).astype(np.int64)
                spot = group * 4096 + band
                kinds, members = np.unique(spot, return_counts=True)
                has = lambda x: kinds[np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)] == x
                alone = members[np.searchsorted(kinds, spot)] == 1
                # at the ends of a batch, what lies beyond isn't known: those rows go to both tiles
                first, final = group == 0 if before else np.zeros(len(group), bool), group == group[-1] if batch is not None else np.zeros(len(group), bool)
                open_ = first | final
                own, up = open_ | ~alone | has(spot - 1), final | has(spot + 1)
                only = np.bincount(group)[group] == 1  # n-grams of one node
                own, up = own & ~(only & ~open_), up & ~(only & ~open_)
                stop = len(gram) - 1 if batch is not None else len(gram)
                if batch is not None:
                    before = bool(len(group) > 1 and group[-1] == group[-2]) or (before and group[-1] == 0)
                    last = (gram[-1], node[-1], n[-1])
                base = mix(gram[:stop].astype(np.int64).view(U64) ^ U64(0xA24BAED4963EE407))
                out = []
                for step, chosen in ((0, own[:stop]), (1, up[:stop])):
                    tile = mix(base[chosen] + (band[:stop][chosen] + step).astype(U64)).view(np.int64)
                    out.append((tile, node[:stop][chosen], n[:stop][chosen], group[:stop][chosen] == group[-1]))
                tile, nodes, sizes, going = (np.concatenate(x) for x in zip(*out))
                if not len(tile):
                    continue
                names, k = np.unique(tile, return_counts=True)
                for t in counts.keys() & set(names.tolist()) if counts else ():  # an n-gram that goes on has its rows counted over batches
                    k[np.searchsorted(names, t)] += counts[t]
                large = names[k > most].tolist()
                counts = {t: int(k[np.searchsorted(names, t)]) for t in np.unique(tile[going]).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int64)), pa.array(nodes.astype(np.int64)), pa.array(sizes.astype(np.int32))], ["tile", "node", "n"])
                if large:
                    yield pa.RecordBatch.from_arrays([pa.array(large, pa.int64()), pa.nulls(len(large), pa.int64()), pa.nulls(len(large), pa.int32())], ["tile", "node", "n"])

        sent = self.texts.select("doc_id", "text").mapInArrow(send, "gram long, node long, n int")
        found = sent.repartition("gram").sortWithinPartitions("gram", "n", "node").mapInArrow(meet, "tile long, node long, n int")
        return staged(self.spark, found, "ngram-shared")

    def first_pairs(self, shared: DataFrame, nodes: DataFrame) -> DataFrame:
        """(tile, u, v, kind): each node v of a tile with the first one u before it within the bound, and all pairs of small tiles, by kind."""
        num, den, most = self.num, self.den, self.tile_rows

        def pair(batches):
            for tile, table in _aligned(batches, ["tile"], 20_000, most):
                node, name = table["node"].to_numpy(), table["tile"].to_numpy()
                i, j, kind = Tiles(tile, table["n"].to_numpy().astype(np.int64), _one(table["body"]), num, den).first_pairs()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name[j], node[i], node[j], kind.astype(np.int32))], ["tile", "u", "v", "kind"])

        rows = shared.where("node is not null").join(nodes.select("node", "body"), "node").select("tile", "n", "node", "body")
        return staged(self.spark, rows.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(pair, "tile long, u long, v long, kind int").where("u != v"), "ngram-met")

    @staticmethod
    def few_of_each(pairs: DataFrame, order: Column) -> DataFrame:
        """For each v the pairs of largest ``order``."""
        best = pairs.groupBy("u", "v").agg(order.alias("k")).groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "u")), False), 1, TRIES).alias("best"))
        return best.select("v", F.explode("best").alias("x")).select("x.u", "v")

    @staticmethod
    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends aren't connected yet."""
        return pairs.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").where("a != b").select("u", "v")

    def more_pairs(self, rows: DataFrame, listed: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
        """For each node a few pairs within the bound whose ends aren't connected, without those tested, by a hash that differs by turn."""
        num, den, most = self.num, self.den, self.tile_rows
        salt = mix(np.array([turn + 1], U64))

        def lowest(pairs, node):
            i, j = pairs
            rank = mix(mix(node[i].view(U64) + salt) ^ node[j].view(U64))
            order = np.lexsort((rank, j))
            begins = np.flatnonzero(np.concatenate([[True], j[order][1:] != j[order][:-1]]))
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            return pairs[:, order[place < TRIES]]

        def pair(batches):
            for tile, table in _aligned(batches, ["tile"], 20_000, most):
                node, label = table["node"].to_numpy(), table["label"].to_numpy()
                held, size = [np.zeros((2, 0), np.int64)], 0
                for i, j in Tiles(tile, table["n"].to_numpy().astype(np.int64), _one(table["body"]), num, den).all_pairs(label, np.ones(len(node), bool)):
                    held.append(np.stack([i, j]))
                    size += len(i)
                    if size > 1 << 20:
                        held, size = [lowest(np.concatenate(held, 1), node)], 0
                pairs = np.concatenate(held, 1)
                if pairs.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(node[x]) for x in lowest(pairs, node)], schema=_PAIR)

        about = nodes.select("node", "body").join(labels, "node")
        dealt = rows.join(about, "node").select("tile", "n", "node", "label", "body").repartition("tile").sortWithinPartitions("tile", "n", "node")
        pairs = dealt.mapInArrow(pair, "u long, v long").unionByName(self.apart(listed, labels)).distinct()
        return self.few_of_each(self.untested(pairs, tested), F.first(F.xxhash64(F.lit(turn), "u", "v")))

    @staticmethod
    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        either = tested.unionByName(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return pairs.join(either, ["u", "v"], "left_anti")

    def merged(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels (node, label) after links of their nodes: components of the labels."""
        ends = links.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        parts = components(self.spark, ends).toDF("label", "part")
        return staged(self.spark, labels.join(parts, "label", "left").select("node", F.coalesce("part", "label").alias("label")), "ngram-labels")

    def other_pairs(self, rows: DataFrame, listed: DataFrame, large: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
        """What is listed or within the bound in the tiles that hold more than one connected part, without the pairs tested already."""
        num, den, chunk = self.num, self.den, max(1, self.tile_rows // 2)

        def pair(batches):
            for tile, table in _aligned(batches, ["tile"], 20_000, None):
                node, label = table["node"].to_numpy(), table["label"].to_numpy()
                few = table["few"].to_numpy(zero_copy_only=False).astype(bool)
                starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
                mixed = np.repeat(np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts), np.diff(np.append(starts, len(tile))))
                if not mixed.any():
                    continue
                rows = np.flatnonzero(mixed)
                tile, node, label, few = tile[rows], node[rows], label[rows], few[rows]
                table = table.take(pa.array(rows))
                for i, j in Tiles(tile, table["n"].to_numpy().astype(np.int64), _one(table["body"].combine_chunks() if table["body"].num_chunks > 1 else table["body"]), num, den).all_pairs(label, few):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], schema=_PAIR)

        about = nodes.join(labels, "node").select("node", "body", "label")
        usual = rows
        if not large.isEmpty():
            usual = rows.join(large, "tile", "left_anti")
        dealt = usual.join(about, "node").select("tile", "n", "node", "label", F.lit(True).alias("few"), "body")
        if not large.isEmpty():
            held = rows.join(large, "tile").join(about.drop("body"), "node")
            parts = held.groupBy("tile", "label").agg(F.count("*").alias("k"))
            # chunks of all rows, and of those outside the largest part: each of these meets all
            cut = parts.groupBy("tile").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("k"), F.max("k").alias("most"), F.count("*").alias("labels")).where("labels > 1")
            cut = staged(self.spark, cut.select("tile", "main", F.ceil(F.col("k") / chunk).cast("int").alias("ca"), F.ceil((F.col("k") - F.col("most")) / chunk).cast("int").alias("cb")), "ngram-tiles")
            held = held.join(cut, "tile").withColumn("few", F.col("label") != F.col("main")).join(about.select("node", "body"), "node")
            spot = F.xxhash64("node")
            every = held.select(F.col("tile"), F.pmod(spot, "ca").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("b"), "n", "node", "label", F.lit(False).alias("few"), "body")
            some = held.where("few").select("tile", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("a"), F.pmod(spot, "cb").cast("int").alias("b"), "n", "node", "label", "few", "body")
            dealt = dealt.unionByName(every.unionByName(some).select(F.xxhash64("tile", "a", "b").alias("tile"), "n", "node", "label", "few", "body"))
        pairs = dealt.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(pair, "u long, v long")
        pairs = pairs.unionByName(self.apart(listed, labels).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        return self.untested(pairs.distinct(), tested)

    def asked_texts(self, wanted: DataFrame) -> DataFrame:
        """The texts whose keys are in ``wanted``, with a few others: a bitmap of the keys, fixed in size, goes to all tasks, so that the rest stays where it is."""
        portion_bytes = self.portion_bytes

        def unite(table: pa.Table) -> pa.Table:
            bits = np.zeros(PART, bool)
            bits[table["spot"].to_numpy() % PART] = True
            return pa.table({"part": table["part"][:1], "body": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        spots = wanted.select(F.col("text_key").bitwiseAND((1 << ASKED) - 1).alias("spot")).distinct()
        bits = np.zeros(1 << ASKED >> 3, np.uint8)
        for row in spots.withColumn("part", F.floor(F.col("spot") / PART)).groupBy("part").applyInArrow(unite, "part long, body binary").collect():
            bits[row["part"] * PART >> 3 : (row["part"] + 1) * PART >> 3] = np.frombuffer(row["body"], np.uint8)
        table = self.spark.sparkContext.broadcast(bits)

        def among(batches):
            for batch in portions(batches, "text", portion_bytes):
                spot = longs(batch.column(2)) & ((1 << ASKED) - 1)
                keep = np.flatnonzero(table.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                if len(keep):
                    yield batch.take(pa.array(keep))

        return self.texts.select("doc_id", "text", "text_key").mapInArrow(among, "doc_id long, text string, text_key long")

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (u, v) that link: u's set meets those of its v in one or more jobs, as many as their n-grams need."""
        sets_of, num, den = self.sets_of(), self.num, self.den
        sizes = pairs.join(nodes.select(F.col("node").alias("v"), "n"), "v").groupBy("u").agg(F.ceil(F.sum("n") / self.job_ngrams).cast("int").alias("jobs"))
        jobs = pairs.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), "jobs").cast("int").alias("job"))
        asked = jobs.select(F.col("v").alias("node"), "u", "job", F.lit(1).alias("turn")).unionByName(jobs.select(F.col("u").alias("node"), "u", "job", F.lit(0).alias("turn")).distinct())
        wanted = staged(self.spark, asked.groupBy("node").agg(F.collect_list(F.struct("u", "job", "turn")).alias("asked")).join(nodes.select("node", "doc_id", "text_key"), "node"), "ngram-asked")

        def deal(batches):
            for batch, sets in sets_of(batches):
                out = [(x["u"], x["job"], x["turn"], node, grams.tobytes()) for node, asked, grams in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets) if _key(grams) == node for x in asked]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["u", "job", "turn", "node", "grams"])

        def check(batches):
            at, own = None, None
            for batch in batches:
                found = []
                for u, turn, node, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                    grams = np.frombuffer(grams.as_buffer(), U64)
                    if turn == 0:
                        at, own = u, grams.copy()
                    elif at == u and linked(own, grams, num, den):
                        found.append((u, node))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_PAIR)

        rows = self.asked_texts(wanted).join(wanted, ["doc_id", "text_key"]).select("text", "node", "asked")
        sent = rows.mapInArrow(deal, "u long, job int, turn int, node long, grams binary").repartition("u", "job").sortWithinPartitions("u", "job", "turn")
        out = staged(self.spark, sent.mapInArrow(check, "u long, v long"), "ngram-links")
        discard(self.spark, wanted)
        return out

    def run(self) -> DataFrame:
        about = self.describe()
        rows = about.where("kind = 0")
        first = F.min(F.struct("doc_id", "text_key"))
        nodes = staged(self.spark, rows.groupBy("node").agg(first.alias("first"), F.first("n").alias("n"), F.first("body").alias("body")).select("node", "first.doc_id", "first.text_key", "n", "body"), "ngram-nodes")
        shared = self.shared(self.levels(about))
        met = self.first_pairs(shared, nodes)
        large = staged(self.spark, shared.where("node is null").select("tile").distinct(), "ngram-large")
        # of the tiles with a pair within the bound whose pairs aren't all listed, and of those too large to tell
        tiles = staged(self.spark, shared.where("node is not null").join(met.where("kind = 0").select("tile").unionByName(large).distinct(), "tile", "left_semi"), "ngram-tiles")
        discard(self.spark, shared)
        listed = staged(self.spark, met.where("kind > 0").select("u", "v").distinct(), "ngram-listed")
        tested = staged(self.spark, self.few_of_each(met.where("kind < 2"), F.count("*")), "ngram-pairs")
        discard(self.spark, met)
        used = [tiles, listed, large, tested]
        labels = self.merged(nodes.select("node", F.col("node").alias("label")), self.links(tested, nodes))
        for turn in range(ROUNDS):
            more = staged(self.spark, self.more_pairs(tiles, listed, nodes, labels, tested, turn), "ngram-pairs")
            used.append(more)
            links, tested = self.links(more, nodes), tested.unionByName(more)
            if links.isEmpty():
                break
            labels = self.merged(labels, links)
        others = staged(self.spark, self.other_pairs(tiles, listed, large, nodes, labels, tested), "ngram-pairs")
        if not others.isEmpty():
            labels = self.merged(labels, self.links(others, nodes))
        classes = nodes.join(labels, "node").select("node", "doc_id", F.col("label").alias("component"))
        named = classes.join(classes.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("node", "component", F.nullif("least", F.lit(NO_ID)).alias("least"))
        linking = F.col("n") > 0
        out = rows.join(named, "node").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_key", F.col("n").alias("n_shingles"), F.when(linking, F.col("component")).alias("class"), F.when(linking, F.col("least")).otherwise(F.nullif("doc_id", F.lit(NO_ID))).alias("component_id"))
        for table in (*used, others):
            discard(self.spark, table)
        return out


def classed_texts(spark: SparkSession, docs: DataFrame, **limits: int) -> DataFrame:
    """``ngram_classes`` with the row's text_key and its class, which doesn't depend on ids; the class of texts without n-grams is null."""
    return Join(spark, docs, **limits).run()


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90)
