"""The SQL of the operators, and the pipeline's stages against plain code."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connection, difference

from meridax.llm.queries import ORACLES, QUERIES
from meridax.llm.tokenizing import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORDS = "the of and to in river stone paper window market garden letter winter bridge copper silver morning evening valley harbour".split()


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert difference(spark, connection(DATA), DATA, QUERIES[name], ORACLES[name]) is None


def rows():
    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choice(WORDS[:5]) if draw.random() < 0.3 else draw.choice(WORDS[5:]) + str(draw.randrange(50)) for _ in range(n))
    out = [(i, "the " + prose(draw.randrange(40, 120)), "en", draw.choice(["a", "b", None])) for i in range(60)]
    out += [(100 + i, out[i][1], "en", "b") for i in range(8)]  # copies
    out += [(200 + i, out[i + 10][1] + " end", "en", "a") for i in range(8)]  # near copies
    out += [(300, "the mail of ann.b@mail.example.com " + prose(50), "en", "a"), (301, "the mail to ann.b@mail.example.com " + prose(50), "en", "b")]
    return out + [(400, None, None, None), (401, "", "en", "a"), (402, "few words", "en", "a"), (403, "buy now # " * 60, "en", "b"), (404, out[5][1], "en", "a"), (404, out[5][1], "en", "a")]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_pipeline(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    given = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars")
    good = stages["quality rules"](spark, given, DATA).collect()
    ids = {r.doc_id for r in good}
    assert not ids & {400, 401, 402, 403} and set(range(60)) <= ids

    docs = spark.createDataFrame(good, given.schema)
    kept = stages["n-gram Jaccard join"](spark, docs, DATA).collect()
    sets = {r.doc_id: shingles(r.text) for r in good}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert sorted(r.doc_id for r in kept) == sorted(set(group.values()))

    private = stages["PII"](spark, spark.createDataFrame(kept, given.schema), DATA).collect()
    texts = {r.doc_id: r.text for r in private}
    assert {r.doc_id for r in private} == {r.doc_id for r in kept} and all(texts[r.doc_id] == r.text for r in kept if r.doc_id < 300)
    assert texts[300].split()[3] == texts[301].split()[3] != "ann.b@mail.example.com"

    docs = spark.createDataFrame(private, given.schema)
    mix = stages["mixing sources to target weights"](spark, docs, DATA).collect()
    copies = Counter(r.doc_id for r in mix)
    assert max(copies.values()) <= 3 and set(copies) <= set(texts) and all(texts[r.doc_id] == r.text for r in mix)
    size = lambda s: sum(len(r.text.split()) for r in private if r.source == s)
    whole = sum(size(s) for s in "a b".split()) + size(None)
    weight, cap, target, free = {"a": 1, "b": 2, None: 3}, {s: 3 * size(s) for s in ("a", "b", None)}, {}, {"a", "b", None}
    while True:  # round by round, as the contract words it
        left = whole - sum(cap[s] for s in weight if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else cap[s] for s in weight}
        above = {s for s in free if target[s] > cap[s]}
        if not above:
            break
        free -= above
    for s in weight:
        assert abs(sum(len(r.text.split()) for r in mix if r.source == s) - target[s]) <= 125

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    packed = stages["best-fit packing"](spark, spark.createDataFrame(mix, given.schema), DATA).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in packed) == Counter((r.doc_id, zlib.crc32(np.array(plain.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in mix)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 4096) + 1
