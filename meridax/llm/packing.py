"""Operator 6: packing by a configuration linear program over the histogram of lengths.

1. Texts become ids plus an end id; longer ones are cut into pieces of ``capacity``. Pieces are written once.
2. Only the histogram of lengths (at most ``capacity`` numbers) comes to the driver.
3. Lengths form at most 256 classes of about equal mass, each rounded up to its longest. The program, cover each class with
   patterns that fit into a sequence, is solved by multiplicative weights with knapsack dynamic programming as pricing,
   until the cover is within 1 % of the dual's bound (else, after 40 rounds, a warning tells the gap; the cover is whole in any case).
4. Patterns are rounded down, then used once more where pieces are left. The rest, and the shortest pieces, whose mass is
   that of the rounding, fill the gaps by best fit, longest first.
5. The plan gives intervals of ranks within a length; each piece finds its place by its rank. Ranks come from counts per
   part and length, so no length's pieces meet in one task.

Null and empty text: only the end id. Repeated rows and ids are packed as rows of their own. A null doc_id stays null. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridax.llm._scratch import staged
from meridax.llm.tokenizing import tokenizer_path, word_cache

CLASSES = 256


def size_classes(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> list[list[list[int]]]:
    """Lengths in classes of about equal mass, the longest first: [length, pieces] of each, in order. A class counts as its longest length.

    The shortest pieces stay out, as many as the rounding up wastes: they fill the gaps that it leaves.
    """
    lengths = sorted(histogram, reverse=True)
    mass = sum(k * histogram[k] for k in lengths) / classes
    out, held = [], 0.0
    for length in lengths:
        if not out or held >= len(out) * mass:
            out.append([])
        out[-1].append([length, histogram[length]])
        held += length * histogram[length]
    waste = sum((c[0][0] - length) * n for c in out for length, n in c)
    while waste > 0 and out:
        length, n = out[-1].pop()
        waste -= length * n + (out[-1][0][0] - length if out[-1] else 0) * n
        if not out[-1]:
            out.pop()
    return out


def best_pattern(weight: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack by dynamic programming: how often each class is taken for the most weight within ``capacity``."""
    order = np.argsort(size, kind="stable")
    size, weight = size[order], weight[order]
    fit = np.searchsorted(size, np.arange(capacity + 1), "right")
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = weight[: fit[c]] + best[c - size[: fit[c]]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= int(size[choice[c]])
    return float(best[capacity]), pattern


def configuration_program(size: np.ndarray, demand: np.ndarray, capacity: int, *, gap: float = 0.01, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (a row each), how often each is used so that every class is covered, and the dual's lower bound on any cover.

    Multiplicative weights with knapsack pricing. First with steps as long as they go: a class's weight falls with what is
    left of its demand, the best pattern of these weights is used until it has covered a class. Then, until cover and bound
    differ by at most ``gap``, patterns and classes play the program as a game, both by optimistic multiplicative weights;
    the knapsack prices the classes' weights, which gives a bound, and adds the pattern that pays most. The cover is whole from
    the first step on; if ``rounds`` don't bring it within ``gap``, the best one is used and a warning tells the gap.
    """
    if not len(size):
        return np.zeros((0, 0), np.int64), np.zeros(0), 0.0
    demand = demand.astype(float)
    used: dict[tuple, float] = {}
    left = demand.copy()
    while left.any():
        _, pattern = best_pattern(size * np.sqrt(left / demand), size, capacity)
        held = np.flatnonzero(pattern * left)
        amount = float((left[held] / pattern[held]).min())
        left[held] = left[held] - amount * pattern[held]
        left[left < 1e-9 * demand] = 0
        used[tuple(pattern.tolist())] = used.get(tuple(pattern.tolist()), 0.0) + amount
    pool, x = np.array(list(used)), np.array(list(used.values()))
    cover = best = x
    y = size * demand / (size * demand).sum()
    bound = 1 / best_pattern(y / demand, size, capacity)[0]
    x, turns = x / x.sum(), 500
    for _ in range(rounds):
        if best.sum() <= (1 + gap) * bound:
            return pool[: len(best)], best, bound
        game = pool.T / demand[:, None]
        game = game / max(1e-300, float(y @ game @ x))
        step = 0.5 / max(1.0, np.sqrt(game.max()))
        a, b, ga, gb = np.log(np.maximum(x, 1e-12)), np.log(np.maximum(y, 1e-12)), game.T @ y, game @ x
        sums = [np.zeros_like(x), np.zeros_like(y)]
        for t in range(turns):
            na, nb = game.T @ y, game @ x
            a, b, ga, gb = a + step * (2 * na - ga), b - step * (2 * nb - gb), na, nb
            x, y = np.exp(a - a.max()), np.exp(b - b.max())
            x, y = x / x.sum(), y / y.sum()
            if 2 * t >= turns:
                sums = [sums[0] + x, sums[1] + y]
        fresh = []
        for p, q in ((sums[0] / sums[0].sum(), sums[1] / sums[1].sum()), (x, y)):
            covered = ((pool.T @ p) / demand).min()
            cover = p / covered if covered > 0 else cover
            best = cover if cover.sum() < best.sum() else best
            value, pattern = best_pattern(q / demand, size, capacity)
            bound = max(bound, 1 / value)
            key = tuple(pattern.tolist())
            if key not in used:
                used[key] = 0.0
                fresh.append(pattern)
        if fresh:
            pool = np.concatenate([pool, fresh])
            x = np.concatenate([sums[0] / sums[0].sum() * 0.9, np.full(len(fresh), 0.1 / len(fresh))])
        else:
            turns *= 2
    warnings.warn(f"the cover is {best.sum() / bound - 1:.1%} above the bound after {rounds} rounds", stacklevel=2)
    return pool[: len(best)], best, bound


class Plan:
    """Sequences as blocks of equal make-up. ``by_patterns``: how many come from the program; ``cover`` and ``bound``: its value and the dual's bound. ``rows``: length, first rank, past the last rank, times a sequence, first sequence, offset."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: v for k, v in histogram.items() if v}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple] = []
        self.sequences = self.in_blocks = 0
        self.open: dict[int, list[tuple[int, tuple]]] = {}  # gap: blocks (sequences, ((length, times), ...))
        self.gaps: list[int] = []
        self._patterns()
        self._best_fit()
        for gap in list(self.gaps):
            for n, content in self.open.pop(gap):
                self._close(n, content)

    def _add(self, gap: int, n: int, content: tuple) -> None:
        if gap not in self.open:
            self.open[gap] = []
            insort(self.gaps, gap)
        self.open[gap].append((n, content))

    def _take(self, gap: int) -> tuple[int, tuple]:
        block = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap]
            self.gaps.remove(gap)
        return block

    def _close(self, n: int, content: tuple) -> None:
        offset = 0
        for length, times in content:
            first = self.next_rank[length]
            self.next_rank[length] = first + n * times
            self.rows.append((length, first, first + n * times, times, self.sequences, offset))
            offset += length * times
        self.sequences += n

    def _patterns(self) -> None:
        """Each pattern as often as the program uses it, rounded down, then once more where the pieces are there."""
        pools = size_classes(self.left, self.capacity)
        sizes, demand = np.array([c[0][0] for c in pools], np.int64), np.array([sum(n for _, n in c) for c in pools], np.int64)
        patterns, amounts, self.bound = configuration_program(sizes, demand, self.capacity)
        self.cover = float(amounts.sum())
        for rounded in (np.floor, np.ceil):
            for p in np.argsort(-amounts, kind="stable"):
                wanted = int(rounded(amounts[p]) - (np.floor(amounts[p]) if rounded is np.ceil else 0))
                held = [(int(c), int(patterns[p, c])) for c in np.flatnonzero(patterns[p])]
                self._use(pools, held, min([wanted, *(sum(n for _, n in pools[c]) // times for c, times in held)]))
        self.by_patterns = self.in_blocks

    def _use(self, pools: list, held: list[tuple[int, int]], copies: int) -> None:
        """So many sequences of a pattern, from the longest lengths of its classes."""
        while copies > 0:
            lengths, n = [], copies
            for c, times in held:  # as many sequences as the longest lengths of each class serve alike
                if pools[c][0][1] >= times:
                    n = min(n, pools[c][0][1] // times)
                    lengths.append((c, pools[c][0][0], times))
                else:
                    n, need = 1, times
                    for length, have in pools[c]:
                        lengths.append((c, length, min(have, need)))
                        need -= min(have, need)
                        if not need:
                            break
            for c, length, times in lengths:
                k = next(i for i, x in enumerate(pools[c]) if x[0] == length)
                pools[c][k][1] -= n * times
                self.left[length] -= n * times
                if not pools[c][k][1]:
                    del pools[c][k]
            self._add(self.capacity - sum(a * b for _, a, b in lengths), n, tuple((a, b) for _, a, b in lengths))
            self.in_blocks += n
            copies -= n

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            rest = self.left[length]
            while rest:
                k = bisect_left(self.gaps, length)
                if k == len(self.gaps):
                    fit = self.capacity // length
                    if rest >= fit:
                        self._add(self.capacity - fit * length, rest // fit, ((length, fit),))
                    if rest % fit:
                        self._add(self.capacity - rest % fit * length, 1, ((length, rest % fit),))
                    break
                gap = self.gaps[k]
                n, content = self._take(gap)
                fit = min(gap // length, rest)
                filled = min(n, rest // fit)
                self._add(gap - fit * length, filled, content + ((length, fit),))
                if n > filled:
                    self._add(gap, n - filled, content)
                rest -= filled * fit

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 6)


def pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int) -> DataFrame:
    """The written pieces: doc_id, piece, start, length, ids_crc32, ids, and their place by part: the nth of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen = word_cache(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                out = []
                some = batch.slice(a, 200)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = cache.ids(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        body = ids[at : at + 4 * capacity]
                        n = len(body) // 4
                        short = np.frombuffer(body, "<u4")
                        out.append((doc_id, k, at // 4, n, zlib.crc32(body), part, seen[n], short.astype("<u2").tobytes() if short.max() < 1 << 16 else body))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(spark, texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary"), "pieces")


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``with_ids``, ids (16-bit where they fit, else 32-bit)."""
    cut = pieces(spark, docs, tokenizer, capacity=capacity, end_id=end_id)
    counts = cut.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(histogram, capacity)
    table = spark.sparkContext.broadcast(plan.table())  # bounded by lengths and patterns, not by pieces
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids).join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *["ids"] * with_ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = rows[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1] if len(rows) else rows
            nth = rank - row[:, 1]
            columns = [*(batch.column(i) for i in range(5)), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(6)] if with_ids else []), ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
