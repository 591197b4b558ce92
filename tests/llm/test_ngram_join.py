"""The n-gram join against all pairs, with tiles and jobs cut small and whole."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meridax.llm import ngram_jaccard

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def classes(rows, k, num):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), float("inf")), float("inf") if d is None else d)
    return sorted((float("inf") if d is None else d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies():
    """Groups whose members differ a little, so that many pairs lie about the threshold, and a passage that many texts share."""
    draw = random.Random(3)
    word = lambda n: f"w{draw.randrange(n)}"
    passage = [word(9) for _ in range(30)]
    rows = []
    for g in range(4):
        base = [word(2000) for _ in range(60 + 40 * g)]
        for _ in range(90):
            text = list(base)
            for _ in range(draw.randrange(5)):
                text[draw.randrange(len(text))] = word(10**6)
            rows.append((draw.randrange(5000), " ".join(text)))
    rows += [(draw.randrange(5000), " ".join(passage + [word(10**5) for _ in range(draw.randrange(9))])) for _ in range(150)]
    rows += [(None, rows[0][1]), (None, "one two"), (6000, "ONE two"), (6001, None), (6002, " "), (6003, "Ä ä"), (6003, "Ä ä")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"tile_rows": 6, "job_ngrams": 300}], ids=["whole", "cut"])
@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_classes_equal_all_pairs(spark, k, num, limits):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_jaccard.ngram_classes(spark, docs, words=k, num=num, **limits).collect()
    plain = lambda x: float("inf") if x is None else x
    assert sorted((plain(r.doc_id), r.n_shingles, plain(r.component_id)) for r in got) == classes(rows, k, num)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = ngram_jaccard.op9_ngram_jaccard(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows, 3, 90)


def test_near_copies_cost_a_few_pairs_each(spark, monkeypatch):
    """A group whose members each have n-grams of their own, rarer than those they share."""
    draw = random.Random(5)
    base, tested = [f"w{draw.randrange(2000)}" for _ in range(160)], []
    rows = []
    for i in range(240):
        text = list(base)
        for _ in range(2):
            text[draw.randrange(len(text))] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    links = ngram_jaccard.Join.links

    def counted(self, pairs, nodes):
        tested.append(pairs.count())
        return links(self, pairs, nodes)

    monkeypatch.setattr(ngram_jaccard.Join, "links", counted)
    got = ngram_jaccard.ngram_classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows, 5, 80)
    assert sum(tested) <= 12 * len(rows), tested


def test_counts_reach_the_driver_as_levels(spark, monkeypatch):
    """A byte for each hash comes to the driver, not a count of eight."""
    docs = spark.createDataFrame([(i, f"one two three four {i // 2} {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    join = ngram_jaccard.Join(spark, docs, words=2)
    kind, sent = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [sent.append(len(r["body"])) or r for r in collect(self)])
    levels = join.levels(join.describe())
    monkeypatch.undo()
    counts = np.zeros(1 << ngram_jaccard.SKETCH, np.int64)
    for part in docs.rdd.glom().collect():
        sets = {tuple(x): x for x in ngram_jaccard.ngram_sets(*ngram_jaccard.utf8(pa.array([r.text for r in part])), 2)} if part else {}
        for x in sets.values():
            counts += np.bincount(ngram_jaccard._slot(x), minlength=len(counts))
    assert levels.dtype == np.uint8 and (levels == ngram_jaccard.rarity(counts)).all() and levels.max() > 0
    assert 0 < sum(sent) <= 1 << ngram_jaccard.SKETCH


def few_near_copies():
    """Long texts of words of their own, of which six have a near copy."""
    draw = random.Random(7)
    rows = [(i, " ".join(f"{draw.randrange(10**6):x}" for _ in range(400))) for i in range(200)]
    return rows + [(1000 + i, rows[i][1] + " end") for i in range(6)]


def test_texts_that_no_pair_asks_for_are_not_shuffled(spark, monkeypatch):
    rows, sent = few_near_copies(), []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    links = ngram_jaccard.Join.links

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    def measured(self, pairs, nodes):
        before = shuffled()
        out = links(self, pairs, nodes)
        sent.append(shuffled() - before)
        return out

    monkeypatch.setattr(ngram_jaccard.Join, "links", measured)
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with more pairs than can be broadcast
    try:
        got = ngram_jaccard.ngram_classes(spark, docs, words=3, num=90).collect()
    finally:
        spark.conf.set(key, usual)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows, 3, 90)
    assert sent and max(sent) < 0.25 * sum(len(t) for _, t in rows), sent


def test_keys_of_asked_texts_lose_none(spark):
    """Rows with the same key as an asked one stay, whatever their ids; others go but for a few."""
    rows = [(i, f"text {i % 500}") for i in range(1000)] + [(None, None), (None, "text 3"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = ngram_jaccard.Join(spark, docs)
    asked = [None, "", *(f"text {i}" for i in range(0, 500, 50))]
    wanted = join.texts.where("text is null or text in ({})".format(", ".join(f"'{t}'" for t in asked if t is not None)))
    got = join.asked_texts(wanted).collect()
    least = sorted(map(tuple, wanted.select("doc_id", "text_key").collect()))
    assert len(least) == 2 * 10 + 2 and set(least) <= {(r.doc_id, r.text_key) for r in got} and len(got) < len(least) + 5
    assert join.asked_texts(wanted.where("false")).count() == 0


def test_small_tiles_are_sent_once(spark, monkeypatch):
    rows, tiles = few_near_copies(), []
    for name in ("more_pairs", "other_pairs"):
        step = getattr(ngram_jaccard.Join, name)
        monkeypatch.setattr(ngram_jaccard.Join, name, lambda self, rows, *rest, step=step: [tiles.append(rows.count())] and step(self, rows, *rest))
    got = ngram_jaccard.ngram_classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows, 3, 90)
    assert tiles and sum(tiles) == 0, tiles


def test_small_tiles_list_all_pairs_within_the_bound():
    draw = np.random.default_rng(11)
    bodies, tile, n = [], [], []
    for t, size in enumerate((2, 9, ngram_jaccard.LISTED, ngram_jaccard.LISTED + 1, ngram_jaccard.FEW + 6)):
        base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
        for _ in range(size):
            own = base.copy()
            own[: draw.integers(0, 40)] = draw.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
            bodies.append(ngram_jaccard.bitmap(np.unique(own), 0.5)), tile.append(t), n.append(len(np.unique(own)))
    order = np.lexsort((n, tile))
    tile, n, bodies = np.array(tile)[order], np.array(n, np.int64)[order], pa.array([bodies[i] for i in order], pa.binary())
    tiles = ngram_jaccard.Tiles(tile, n, bodies, 90, 100)
    i, j = np.triu_indices(len(tile), 1)
    i, j = (x[tile[i] == tile[j]] for x in (i, j))
    i, j = (x[tiles.within(i, j)] for x in (i, j))
    size = np.bincount(tile)[tile]
    a, b, kind = tiles.first_pairs()
    first = {(y, min(i[j == y])) for y in set(j.tolist())}
    assert {(y, x) for x, y in zip(a[kind < 2].tolist(), b[kind < 2].tolist())} == first
    assert (kind == 0).sum() and (kind == 2).sum() and ((kind == 0) == (size[b] > ngram_jaccard.LISTED)).all()
    listed = size[i] <= ngram_jaccard.LISTED
    assert sorted(zip(a[kind > 0].tolist(), b[kind > 0].tolist())) == sorted(zip(i[listed].tolist(), j[listed].tolist()))
