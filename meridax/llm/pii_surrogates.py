"""Operator 3: surrogates for personal data and secrets, in DataFrame operations only.

One pattern finds e-mail addresses, phone numbers, payment cards, national and bank numbers, network addresses, secrets
and titled names. Each gets a replacement that depends on a key and its own value, so that the same entity gets the same
surrogate everywhere (coreference). Numbers, secrets and the part of an address before the @ keep length, punctuation and
the kind of each character; a domain becomes one of example.net, the same for equal domains; a private network address
stays private; names keep title (and so gender), number of words and script (Latin, Cyrillic or Greek), and equal given
or family names stay equal. A card or bank number with a valid check digit gets a valid one.

A check over all different values finds surrogates that two values share or that are themselves a value of the corpus;
those values are keyed anew until none is left, from the third time on in a wider space (longer names and addresses,
another private network). Only such values, which are few, are joined back; all others are computed in place.

Null text stays null, empty text empty; texts of any length are read whole. Repeated rows get equal results. Other columns,
a null doc_id too, pass through; an input column n_entities is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._columns import apart
from meridax.llm._scratch import discard, staged

#: Titles that tell a gender.
TITLES_M = "Mr Herr Monsieur Señor Sr Don".split()
TITLES_F = "Mrs Ms Miss Frau Madame Mme Señora Sra Doña".split()
_TITLES = "|".join(sorted(TITLES_M + TITLES_F, key=len, reverse=True))
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
#: In order: the first kind whose pattern fits the whole match names it.
KINDS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "name": f"(?<![\\p{{L}}])(?=[DFHMS])(?:{_TITLES})\\.? \\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)?",
    "phone": "\\+\\d{1,3}[ .-]?\\(?\\d{2,4}\\)?(?:[ .-]?\\d{2,4}){2,4}(?!\\d)|(?<!\\d)\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}(?!\\d)|(?<![\\d.-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\d-])",
    "ip": f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\d|\\.\\d)",
    "national": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "bank": "(?<![A-Za-z0-9])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": "(?<![\\dA-Za-z])(?:\\d{13,19}|\\d{4}[ -]\\d{6}[ -]\\d{5}|\\d{4}(?:[ -]\\d{4}){2}[ -]\\d{1,7})(?![\\dA-Za-z])",
    "secret": "(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
    "|(?<=[\"'])(?<=(?:token|secret|password|api_key|apikey) ?[=:] ?[\"'])[A-Za-z0-9_+/=-]{8,128}(?=[\"'])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def kind_of(value: Column) -> Column:
    out = F.lit("secret")
    for kind in [k for k in reversed(KINDS) if k != "secret"]:
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: an expression used at many places is else copied to each, in the plan too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stream(seed: Column) -> Column:
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _number(stream: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substring(stream, at, F.lit(digits)), 16, 10).cast("long")


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _like(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """``value`` with each ASCII digit and letter replaced by one of its kind, by a keyed stream."""

    def swap(c: Column, i: Column) -> Column:
        by = lambda h: F.when(c.between("0", "9"), (h % 10).cast("string")).when(c.between("a", "z"), F.char(h % 26 + 97)).when(c.between("A", "Z"), F.char(h % 26 + 65)).otherwise(c)
        out = _let(_number(stream, (i % 64) * 2 + 1, 2), by)
        if hexadecimal is not None:
            low = F.lower(F.substring(stream, i % 128 + 1, F.lit(1)))
            out = F.when(hexadecimal & c.rlike("[0-9a-f]"), low).when(hexadecimal & c.rlike("[0-9A-F]"), F.upper(low)).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(value), swap), "")


def _luhn(digits: Column) -> Column:
    """The sum of the check-digit rule over a string of digits."""
    terms = F.transform(_chars(F.reverse(digits)), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


#: Of two letters each.
_SYLLABLES = "ba be da de ga gi ka ke la le ma mi na ne pa pe ra ri sa se ta te va vi do lu mo no po ro so to".split()


def _syllables(stream: Column, first: int, n: int) -> Column:
    table = F.lit("".join(_SYLLABLES))
    return F.concat(*[F.substring(table, (_number(stream, F.lit(first + 2 * k), 2) % len(_SYLLABLES) * 2 + 1).cast("int"), F.lit(2)) for k in range(n)])


def _in_script_of(word: Column, made: Column) -> Column:
    def written(own: Column) -> Column:
        cyrillic = F.translate(own, "abdegiklmnoprstuvBDGKLMNPRSTV", "абдегиклмнопрстувБДГКЛМНПРСТВ")
        greek = F.translate(own, "abdegiklmnoprstuvBDGKLMNPRSTV", "αβδεγικλμνοπρστυφΒΔΓΚΛΜΝΠΡΣΤΦ")
        return F.when(word.rlike("\\p{IsCyrillic}"), cyrillic).when(word.rlike("\\p{IsGreek}"), greek).otherwise(own)

    return _let(F.initcap(made), written)


def _mod97(compact: Column) -> Column:
    """The remainder by 97 of a bank number's characters, letters as 10 to 35."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(compact), F.lit(0), step)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of one value; ``attempt`` (0, 1, ...) keys it anew after a collision."""

    def keyed(x: Column) -> Column:
        seed = F.concat_ws("\x1f", F.lit(key), x["kind"], x["value"], x["attempt"].cast("string"))
        return _let(_stream(seed), lambda stream: _made(x["kind"], x["value"], x["attempt"], stream, key))

    return _let(F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt")), keyed)


def _made(kind: Column, value: Column, attempt: Column, stream: Column, key: str) -> Column:
    like = _like(value, stream)
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    host = F.pmod(F.xxhash64(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain)), F.lit(10**9)).cast("string")
    wider = F.when(attempt > 2, F.substring(stream, F.lit(100), F.lit(12))).otherwise("")  # letters and digits
    at_host = _let(host, lambda host: F.when(value.rlike("[a-z]"), F.concat(F.lit("d"), host, F.lit(".example.net"))).otherwise(F.concat(F.lit("D"), host, F.lit(".EXAMPLE.NET"))))
    email = F.concat(_like(local, stream), wider, F.lit("@"), at_host)
    octet = lambda k: (_number(stream, F.lit(1 + 4 * k), 4) % 254 + 1).cast("string")
    public = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    inner = F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))
    middle = F.concat_ws(".", F.lit("172"), (_number(stream, F.lit(30), 2) % 16 + 16).cast("string"), octet(2), octet(3))
    # private networks: their own first, then a larger one, at last the addresses that nobody may use
    private = F.when(value.startswith("10.") | (attempt > 2), inner).when(value.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), octet(2), octet(3))).otherwise(middle)
    reserved = F.concat_ws(".", (_number(stream, F.lit(40), 2) % 15 + 240).cast("string"), octet(1), octet(2), octet(3))
    ip = F.when(value.rlike("^(?:10|192\\.168|172\\.(?:1[6-9]|2\\d|3[01]))\\."), F.when(attempt > 8, reserved).otherwise(private)).otherwise(public)
    phone = _let(F.regexp_extract(value, "^(\\+\\d{1,2}(?=[ .(-])|)", 1), lambda lead: F.concat(lead, _let(like, lambda like: F.substring(like, F.length(lead) + 1, F.length(like)))))
    digits = F.translate(value, " -", "")

    def card_like(like: Column) -> Column:
        check = lambda body: F.pmod(10 - _luhn(F.concat(F.translate(body, " -", ""), F.lit("0"))) % 10, F.lit(10)).cast("string")
        body = F.concat(F.substring(value, F.lit(1), F.lit(1)), F.substring(like, F.lit(2), F.length(like) - 2))
        return _let(body, lambda body: F.concat(body, F.when(_luhn(digits) % 10 == 0, check(body)).otherwise(F.substring(like, F.length(like), F.lit(1)))))

    def bank_like(like: Column) -> Column:
        country, account = F.substring(value, F.lit(1), F.lit(2)), F.substring(like, F.lit(5), F.length(like))
        compact = F.translate(value, " ", "")
        valid = _mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))) == 1
        sign = F.lpad((98 - _mod97(F.concat(F.translate(account, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, F.when(valid, sign).otherwise(F.substring(like, F.lit(3), F.lit(2))), account)

    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    by_case = _let(hexadecimal, lambda hexadecimal: _like(value, stream, hexadecimal))
    secret = _let(F.regexp_extract(value, "^(AKIA|gh[pousr]_|sk-|)", 1), lambda head: F.concat(head, F.substring(by_case, F.length(head) + 1, F.length(value))))

    def named(title: Column) -> Column:
        family, given = F.substring_index(value, " ", -1), F.when(F.size(F.split(value, " ")) > 2, F.get(F.split(value, " "), F.lit(1)))
        female = F.regexp_replace(title, "\\.", "").isin(TITLES_F)
        syllables = lambda part, word, n: _let(_stream(F.concat_ws("\x1f", F.lit(key), F.lit(part), word, attempt.cast("string"))), lambda own: _syllables(own, 1, n))
        surname = _in_script_of(family, F.concat(syllables("family", family, 4), F.when(attempt > 2, _syllables(stream, 1, 3)).otherwise("")))
        end = F.when(female, F.lit("ina")).otherwise(F.lit("us"))
        first = F.when(given.isNotNull(), _in_script_of(given, F.concat(syllables(F.when(female, F.lit("f")).otherwise("m"), given, 3), end)))
        return F.concat_ws(" ", title, first, surname)

    by_kind = {"email": email, "name": _let(F.substring_index(value, " ", 1), named), "phone": phone, "ip": ip, "national": like, "bank": _let(like, bank_like), "card": _let(like, card_like)}
    out = secret
    for k, made in by_kind.items():
        out = F.when(kind == k, made).otherwise(out)
    return out


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, value) of each match in each text, repeated ones too."""
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0))).alias("value"))
    return found.select("doc_id", "text_key", kind_of(F.col("value")).alias("kind"), "value")


def collisions(spark: SparkSession, values: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, value, attempt) of the values whose first surrogate is shared or is itself a value: keyed anew until all are distinct.

    Each round keys only the losers of the one before. If ``rounds`` aren't enough, ValueError tells how many are left.
    """
    keyed = lambda frame: frame.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
    fixed = staged(spark, keyed(values.select("kind", "value", F.lit(0).alias("attempt"))), "pii-values")
    left = fixed
    for _ in range(rounds):
        taken = fixed.select("kind", F.col("value").alias("made"), F.lit(1).alias("original"), F.lit(None).cast("string").alias("value"))
        owner = fixed.select("kind", "made", F.lit(0).alias("original"), "value").unionByName(taken).groupBy("kind", "made").agg(F.max("original").alias("original"), F.min("value").alias("owner"), F.count("value").alias("n"))
        bad = owner.where("owner is not null and (original = 1 or n > 1)")
        losers = staged(spark, keyed(fixed.join(bad, ["kind", "made"]).where("original = 1 or value != owner").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))), "pii-losers")
        if losers.isEmpty():
            return fixed.where("attempt > 0").select("kind", "value", "attempt")
        anew = losers.select("kind", "value", F.col("attempt").alias("next"), F.col("made").alias("next_made"))
        before, fixed = fixed, staged(spark, fixed.join(anew, ["kind", "value"], "left").select("kind", "value", F.coalesce("next", "attempt").alias("attempt"), F.coalesce("next_made", "made").alias("made")), "pii-values")
        discard(spark, before)
        left = losers
    raise ValueError(f"{left.count()} values have no surrogate of their own after {rounds} rounds")


def with_surrogates(spark: SparkSession, docs: DataFrame, *, key: str = "corpus", broadcast_rows: int = 20_000) -> DataFrame:
    """``docs`` with the replaced text and, as a last column, n_entities. ``broadcast_rows``: up to so many re-keyed entities are broadcast; more are joined."""
    order = list(docs.columns)
    docs, back = apart(docs, ["n_entities"], ["doc_id", "text"])
    pairs = detected(docs)
    again = collisions(spark, pairs.select("kind", "value").distinct(), key)
    frame = docs.withColumn("found", F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0)))
    rekeyed = None
    if not again.isEmpty():
        many = pairs.join(again, ["kind", "value"]).select("doc_id", "text_key", "value", "attempt").distinct()
        per_text = many.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias("again"))
        per_text = staged(spark, per_text.select(F.col("doc_id").alias("id"), "text_key", "again"), "pii-again")
        if per_text.count() <= broadcast_rows:
            per_text = F.broadcast(per_text)
        frame = frame.join(per_text, frame["doc_id"].eqNullSafe(per_text["id"]) & (F.xxhash64(frame["text"]) == per_text["text_key"]), "left")
        rekeyed = F.col("again")
    attempt = lambda v: F.lit(0) if rekeyed is None else F.coalesce(F.element_at(rekeyed, v), F.lit(0))
    made = F.transform("found", lambda v: surrogate(kind_of(v), v, attempt(v), key))
    pieces = F.split("text", ANY)
    joined = F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    names = [c for c in order if c.lower() != "n_entities"]
    out = [text.alias(c) if c.lower() == "text" else column for c, column in zip(names, back)]
    return frame.select(*out, F.coalesce(F.when(F.col("text").isNotNull(), F.size("found")), F.lit(0)).alias("n_entities"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
