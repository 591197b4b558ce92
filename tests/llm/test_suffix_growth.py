"""Substring dedup on 20 MB: how many messages blocks and ranges exchange, how even ranges are, and what is shuffled."""

import numpy as np
import pytest

from meridax.llm import suffix_dedup
from meridax.llm._bytes import utf8


@pytest.fixture(scope="module")
def run(spark):
    """Rows of the first messages, bytes shuffled and the result, over 1,000 unlike texts, each twice."""
    docs = spark.range(2000, numPartitions=2).selectExpr("id as doc_id", "array_join(transform(sequence(1, 150), x -> sha2(concat_ws('-', id % 1000, x), 256)), ' ') as text")
    made, plain, bus = {}, suffix_dedup.staged, spark.sparkContext._jsc.sc().listenerBus()

    def shuffled() -> int:
        bus.waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    suffix_dedup.staged = lambda spark, frame, name: made.setdefault(name, plain(spark, frame, name))
    try:
        before = shuffled()
        rows = suffix_dedup.suffix_dedup(spark, docs, with_kept=False).collect()
        return made["dedup-masks"].count(), shuffled() - before, rows
    finally:
        suffix_dedup.staged = plain
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages_are_few(run):
    messages, _, rows = run
    size = sum(r.n_bytes for r in rows)
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in rows} == {(i, r.n_bytes * (i >= 1000), int(i >= 1000)) for r in rows for i in [r.doc_id]}
    assert len(rows) == 2000 and size > 19e6 and messages <= 5 * size / 1e6


def test_blocks_are_dealt_once(run):
    _, sent, rows = run
    assert sent < 3.3 * sum(r.n_bytes for r in rows)


def test_ranges_are_even(spark):
    rows = spark.range(60).selectExpr("array_join(transform(sequence(1, 150), x -> sha2(concat_ws('-', id, x), 256)), ' ') as text").toArrow()
    grams, _ = suffix_dedup.Runs(*utf8(rows.column(0)), 50).grams()
    parts, edges = suffix_dedup._slices(grams, 64)
    assert len(parts) == 64 and np.diff(edges).max() < 1.5 * len(grams) / 64
