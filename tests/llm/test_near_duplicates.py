"""The near-duplicate stage keeps one row of each class, whatever the ids."""

from collections import Counter

DATA = "/root/testdata/sf0.001"


def text(word, n=40):
    return " ".join(f"{word}{i}" for i in range(n))


def test_null_and_reused_ids_lose_no_class(spark):
    import corpus_pipeline

    rows = [(None, text(w)) for w in ("ash", "birch", "cedar")]
    rows += [(7, text("elm")), (7, text("fir")), (8, text("elm") + " end"), (9, text("gum")), (9, text("gum"))]
    rows += [(10, text("ash")), (None, text("hazel")), (None, text("hazel") + " end"), (11, text("fir") + " end")]
    rows = [(i, t, f"s{k}") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, DATA)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {tuple(r) for r in got} <= set(rows)
    # ash is kept under its id; the copies of elm and fir yield to 7, which keeps both of its texts
    assert Counter((r.doc_id, r.text.split()[0]) for r in got) == Counter([(10, "ash0"), (None, "birch0"), (None, "cedar0"), (7, "elm0"), (7, "fir0"), (9, "gum0"), (None, "hazel0")])
