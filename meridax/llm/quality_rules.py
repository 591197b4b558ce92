"""Operator 10: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

All columns are built-in expressions over ``text``; no user function, no join, no shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``. Null text has no words and no lines, as empty text; both fail the base rule on length.
Texts of any length are measured whole. Repeated rows are judged alike; other columns, a null doc_id too, pass through, but
for those named like a measure, which the measures replace.
An empty table gives an empty result. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._columns import apart

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for was with as on be at by this it from or an are a "
    "le la les de des et en un une que du est qui pour dans sur pas par plus ce au "
    "der die das und ist von zu mit den ein eine nicht sich auf im dem für es auch wie "
    "el los las del y se por su con para al lo no una es como más o si"
).split()

STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` for texts that have the measure (it is null where it makes no sense)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Wide limits: a rule fires on texts that are mostly symbols, strings without word breaks, lists or copies of a line.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("marks_per_word", None, 0.8),
    Rule("stop_word_share", 0.04, None),
    Rule("dup_line_share", None, 0.6),
    Rule("repeat_word_share", None, 0.3),
)


MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words mean_word_chars symbols_per_word marks_per_word stop_word_share dup_line_share repeat_word_share base_failed kept".split()


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def measured(docs: DataFrame, *, window: int = 8) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the rules."""
    docs, back = apart(docs, MEASURES, ["text"])
    own = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = lambda kinds: F.length(text) - F.length(F.translate(text, kinds, ""))
    frame = docs.select(
        *own,
        _words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
        (F.length(text) - chars(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        chars("#*$%&|<>").cast("long").alias("n_symbols"),
        chars("!?#*$%&|<>{}[]~^_=+\\").cast("long").alias("n_marks"),
    )
    # hashes of 1, 2, 4, ... words, each from two of half as many
    frame = frame.withColumn("run1", F.transform("words", lambda w: F.xxhash64(w)))
    have = 1
    while have < window:
        step = min(have, window - have)
        longer = F.zip_with(f"run{have}", F.slice(f"run{have}", step + 1, F.greatest(F.lit(0), F.size(f"run{have}") - step)), lambda a, b: F.xxhash64(a, b))
        have += step
        frame = frame.withColumn(f"run{have}", F.slice(longer, 1, F.greatest(F.lit(0), F.size("words") - (have - 1))))
    frame = frame.withColumn("windows", F.when(F.size("words") >= window, F.col(f"run{window}")))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("ordered", F.when(F.size("windows") > F.size(F.array_distinct("windows")), pairs))
    frame = frame.withColumn("twice", F.when(F.col("ordered").isNotNull(), _places_of_repeats()))
    step = lambda i: F.least(F.lit(window), F.get("twice", i + 1) - F.get("twice", i))
    # a window counts its words up to the next such window, the last one all of its own
    covered = F.when(F.size("twice") > 1, F.aggregate(F.sequence(F.lit(0), F.size("twice") - 2), F.lit(window), lambda total, i: total + step(i)))
    n = F.size("words")
    # input columns get their names back in a select of their own: beside the measures, a name like "twice" would be an alias that a lambda's expression takes
    made = frame.select(
        *own,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.try_divide("word_chars", n).alias("mean_word_chars"),
        F.try_divide("n_symbols", n).alias("symbols_per_word"),
        F.try_divide("n_marks", n).alias("marks_per_word"),
        F.try_divide(F.size(F.filter("words", lambda w: w.isin(STOP_FORMS))), n).alias("stop_word_share"),
        F.try_divide(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")).alias("dup_line_share"),
    ).withColumn("repeat_word_share", F.try_divide("n_repeat_words", "n_words"))
    return made.select(*back, *[c for c in MEASURES if c in made.columns])


def _places_of_repeats() -> Column:
    """Places (from 0) of the windows whose hash occurs more than once, ascending: those with an equal neighbour in the order of hashes."""
    hash_ = lambda i: F.get("ordered", i)["h"]
    equal = lambda i: hash_(i).eqNullSafe(hash_(i - 1)) | hash_(i).eqNullSafe(hash_(i + 1))
    return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("ordered") - 1), equal), lambda i: F.get("ordered", i)["i"]))


def verdict(rules=RULES) -> Column:
    """One boolean expression of a threshold table."""
    kept = F.lit(True)
    for rule in rules:
        for ok in ([F.col(rule.measure) >= rule.low] if rule.low is not None else []) + ([F.col(rule.measure) <= rule.high] if rule.high is not None else []):
            kept = kept & F.coalesce(ok, F.lit(True))
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with all measures, base_failed and kept."""
    return measured(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """The kept rows of ``docs``, with its columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that extra columns can't clash with measures
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)])
    seen = judged(named.withColumn("text", F.col(own[docs.columns.index("text")])), rules)
    # the row number keeps the optimizer from moving the filter below the projection, where it would spell out all measures anew for each use
    seen = seen.select(*own, "kept", F.monotonically_increasing_id().alias("row")).where("kept and row >= 0")
    return seen.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
