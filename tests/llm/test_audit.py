"""The audit finds records that one replica lacks."""

import numpy as np
import pytest

from meridax.llm.warc_fixity import Tree, audit, read_warc, write_archive


def archive(spark, files):
    rows = [(f, bytearray(b"".join(b"%06d" % i for i in range(n))), bytearray((np.arange(n + 1) * 6).astype("<i8").tobytes()), bytearray(np.arange(n).astype("<i8").tobytes())) for f, n in files.items()]
    return spark.createDataFrame(rows, "file string, image binary, offsets binary, page_ids binary")


@pytest.mark.parametrize("a, b", [({"x": 300, "y": 3}, {"x": 200, "y": 3}), ({"x": 200}, {"x": 300}), ({"x": 3}, {"x": 3, "y": 2, "z": 2}), ({"x": 3, "y": 300}, {"x": 3})], ids=["truncated", "longer", "extra files", "missing file"])
def test_missing_and_added_records(spark, a, b):
    found = {tuple(r) for r in audit(Tree(spark, archive(spark, a)), Tree(spark, archive(spark, b))).collect()}
    records = lambda files: {(f, i) for f, n in files.items() for i in range(n)}
    assert found == records(a) ^ records(b)


def test_damaged_truncated_and_empty(spark):
    files = {"x": 300, "y": 17, "z": 1}
    whole = archive(spark, files)
    tree = Tree(spark, whole)
    assert audit(tree, Tree(spark, whole)).count() == 0
    hurt = whole.rdd.map(lambda r: (r.file, bytearray(b"9" + bytes(r.image)[1:]) if r.file != "y" else r.image, r.offsets, r.page_ids)).toDF(whole.schema)
    assert sorted(tuple(r) for r in audit(tree, Tree(spark, hurt)).collect()) == [("x", 0), ("z", 0)]
    none = archive(spark, {"x": 1}).where("false")
    assert audit(Tree(spark, none), Tree(spark, none)).count() == 0
    assert audit(tree, Tree(spark, none)).count() == audit(Tree(spark, none), tree).count() == sum(files.values())


def test_many_files_against_few(spark):
    many = {f"f{i:03d}": 1 + i % 20 for i in range(300)}
    few = {k: n for k, n in many.items() if k < "f002"}
    found = audit(Tree(spark, archive(spark, many)), Tree(spark, archive(spark, few))).collect()
    assert sorted(tuple(r) for r in found) == sorted((f, i) for f, n in many.items() if f >= "f002" for i in range(n))


def test_line_breaks_in_urls_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://a\r\n\r\nb", "x\r\n\r\ny"), (2, "", ""), (None, None, None)], "page_id int, url string, html string")
    images = [r.image for r in write_archive(spark, pages).collect()]
    records = [(h["X-Page-ID"], h["WARC-Target-URI"], body.decode()) for image in images for _, _, h, body in read_warc(bytes(image))]
    assert sorted(records) == [("-1", "", ""), ("1", "http://a%0D%0A%0D%0Ab", "x\r\n\r\ny"), ("2", "", "")]
    assert write_archive(spark, pages.where("false")).count() == 0
