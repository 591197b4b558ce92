"""Each operator on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables; and against plain code."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from meridax.llm import elias_fano, flac_media, language_id, ngram_jaccard, packing, pii_surrogates, quality_rules, source_mixing, suffix_dedup, warc_fixity
from meridax.llm.tokenizing import tokenizer_path

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
ROWS = [(1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "x", "fr", "b"), (5, "x", "fr", "b"), (6, "a\tb\n\n a\x0bb", None, "c"), (None, "the of and to in " * 30, "en", None), (7, "ÉÀ ñ ß 漢字 " * 40, "fr", "a"), (8, " \n ", "en", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'k' as kept", "1 as size", "2 as n_words", "'p' as part")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(rows, length=50):
    """doc_id -> (bytes, removed) by a table of all windows; a null id is larger than all."""
    first: dict[bytes, float] = {}
    raw = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((i, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, docs, none, hot):
    got = suffix_dedup.suffix_dedup(spark, docs, hot_documents=hot).collect()
    assert sorted(((float("inf") if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=repr) == removed([(r[0], r[1]) for r in ROWS])
    assert suffix_dedup.suffix_dedup(spark, none).count() == 0


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = elias_fano.read_tokens(elias_fano.write_tokens(spark, docs, path)).orderBy("start").collect()
    wanted = Counter((r[0], np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in ROWS)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == wanted
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert elias_fano.read_tokens(elias_fano.write_tokens(spark, none, path)).count() == 0


def test_packing(spark, docs, none):
    got = packing.packed(spark, docs, tokenizer_path("word_bpe_49k.json"), capacity=512).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rows.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 512
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in ROWS)
    assert packing.packed(spark, none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_media(spark, docs, none):
    got = flac_media.load(flac_media.store(docs)).collect()
    pad = lambda b: b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
    assert Counter((r.doc_id, r.payload_sha256) for r in got) == Counter((r[0], hashlib.sha256(pad((r[1] or "").encode())).hexdigest()) for r in ROWS)
    assert flac_media.load(flac_media.store(none)).count() == 0


def test_damaged_media_is_found():
    data = np.frombuffer(LONG[:6400].encode(), np.uint8)
    stream = bytearray(flac_media.encode(data, np.array([0, len(data)]))[0])
    stream[len(stream) // 2] ^= 1
    with pytest.raises(ValueError):
        flac_media.decode([bytes(stream)])


def test_language(spark, docs, none):
    model = language_id.fit(spark, docs.where("doc_id is not null").select("doc_id", "text", "lang"), slots=1 << 16, least=1)
    got = language_id.predict(spark, docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got}[3] == {r.doc_id: r.lang_pred for r in got}[8] == "und"
    assert language_id.predict(spark, none, language_id.fit(spark, none, slots=1 << 16)).count() == 0


def test_classes(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_classes(spark, docs, words=3, num=90).collect()}
    assert got[2][1] == got[1][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4) and got[8] == (0, 8) and got[5] == (1, 5) and got[None][1] is None
    assert ngram_jaccard.ngram_classes(spark, none).count() == 0


def test_surrogates(spark, docs, none):
    assert Counter(pii_surrogates.with_surrogates(spark, docs).select("doc_id", "text").collect()) == Counter((r[0], r[1]) for r in ROWS)
    frame = spark.createDataFrame([(1, "ann.b@mail.example.com 4111111111111111 10.1.2.3"), (2, "ann.b@mail.example.com")], "doc_id int, text string")
    one, two = (r.text for r in pii_surrogates.with_surrogates(spark, frame).orderBy("doc_id").collect())
    assert one.split()[0] == two and "ann.b" not in one and one.split()[2].startswith("10.")
    digits = [int(d) for d in one.split()[1]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert pii_surrogates.with_surrogates(spark, none).count() == 0


def test_quality_and_mixing(spark, docs, none):
    assert quality_rules.quality_filter(docs).columns == docs.columns
    assert quality_rules.judged(none).count() == 0 and quality_rules.judged(docs.select("doc_id", "text")).count() == len(ROWS)
    mix = source_mixing.mixed(docs.select("doc_id", "text", "source")).collect()
    assert len(mix) == len(ROWS) and all(0 <= r.times <= 3 for r in mix)
    assert source_mixing.mixed(none).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i % 40, f"u{i}", "x" * i) for i in range(300)] + [(None, None, None)], "page_id int, url string, html string")
    archive = warc_fixity.write_archive(spark, pages, file_bytes=4000)
    tree = warc_fixity.Tree(spark, archive)
    assert warc_fixity.audit(tree, warc_fixity.Tree(spark, archive)).count() == 0
    found = {(r.file, r.node) for r in warc_fixity.audit(tree, warc_fixity.Tree(spark, warc_fixity.damaged(spark, archive, 7))).collect()}
    assert found == {(r.file, r.node) for r in tree.leaves.collect() if zlib.crc32(f"{r.file}:{r.node}".encode()) % 7 == 0}
