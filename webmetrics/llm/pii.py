"""Personal data, and words that give it away, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Then the corpus itself says which
words reveal them: for an entity e and a word t beside it, p(e|t) is the share of t's occurrences that stand beside e.
Of the -log2 p(e) bits that name e, knowing t discloses log2 p(e|t) - log2 p(e). Words that disclose most of them are
replaced by what they are, and words that disclose all of them are removed, wherever in the corpus they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

# Kinds in their order and their patterns. Parts that cannot match otherwise are possessive, and runs
# start where they begin or the last match ended, so that long runs of one kind of character cost no more than others.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
TERM = "term"
_IN_WORD = r"[\p{L}\p{M}\p{N}]"
WORD = rf"[\p{{L}}\p{{N}}]{_IN_WORD}*+"
#: Function words of up to three letters, which name nobody however they are spread; they are not judged.
FUNCTION_WORDS = (
    "a all and any are as at be but by can for had has he her his how i if in is it its me my no nor not of off on or our out she so the to "
    "too us was we who why yet you am bei bin das dem den der des die du ein er es für ihm ihn ihr im ist mit ob sie um und uns vom von vor "
    "wer wie wir zu zum zur au aux ce ces de du elle en est et eux il ils je la le les lui ma mes moi ne nos on ou où par pas qui que sa ses "
    "se sur ta te tes toi tu un une vos al con del el ella las los mi mis más muy nos por sin sus tus una uno y ya"
).split()

#: Code points on either side of an entity, within its line, whose words may reveal it.
REACH = 80
#: Share of an entity's bits above which a word is generalised, and above which it is removed.
GENERALISE, REMOVE = 0.85, 0.999
#: Different surroundings in which word and entity must meet; one meeting is no estimate.
LEAST_CONTEXTS = 3

_SPAN = "struct<start:bigint,end:bigint,value:string>"

#: Longs of a membership filter of words.
FILTER_LONGS = 1 << 16


def _constant(values: list[int]) -> Column:
    """An array of longs that the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


def _bits(keys: DataFrame, key: Column) -> Column:
    """A membership filter of `keys`; `FILTER_LONGS` numbers at most reach the driver."""
    bit = F.pmod(key, F.lit(FILTER_LONGS * 64))
    longs = keys.select(F.shiftright(bit, 6).alias("k"), _left(F.lit(1).cast("long"), bit % 64).alias("v"))
    values = [0] * FILTER_LONGS
    for row in longs.groupBy("k").agg(F.bit_or("v").alias("v")).collect():
        values[row["k"]] = row["v"]
    return _constant(values)


def _passes(bits: Column, key: Column) -> Column:
    bit = F.pmod(key, F.lit(FILTER_LONGS * 64))
    return _right(F.get(bits, F.shiftright(bit, 6).cast("int")), bit % 64).bitwiseAND(F.lit(1).cast("long")) != 0


def _matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points: gaps and matches in turn add up.

    Of long texts with many matches only those that `keep` holds for should be kept, as the array is copied for each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sized = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        span = F.struct(start.alias("start"), (start + z["size"]).alias("end"), z["value"].alias("value"))
        out = F.concat(acc["out"], F.array(span))
        out = out if keep is None else F.when(keep(z["value"]), out).otherwise(acc["out"])
        return F.struct((start + z["size"]).alias("at"), out.alias("out"))

    return F.aggregate(sized, empty, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a run of at most 19 digits passes: every second from the right is doubled, 9 taken off above 9."""
    places = F.split(F.reverse(digits), "(?<=.)(?=.)")

    def value(digit: Column, place: Column) -> Column:
        doubled = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All base spans of a text (kind, start, end, value), by kind as listed, then start; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    email = F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, IP), lambda s: s["value"].rlike(IP_PARTS))).otherwise(none)

    def card(s: Column) -> Column:
        digits = _digits(s["value"])
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)

    cards = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(_matches(text, CARD), card)).otherwise(none)
    phone = F.filter(_matches(text, PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15))
    phone = F.when(text.rlike(r"\+[0-9]"), phone).otherwise(none)
    return F.concat(*(_of_kind(k, v) for k, v in zip(KINDS, (email, ip, cards, phone), strict=True)))


def _beside(text: Column, spans: Column) -> Column:
    """For each span its entity, the stretches before and after it, within the line, with their places, and what spans reach there.

    One code point more is read on either side, and a word that reaches it is left out, so that none is cut.
    """

    def sides(s: Column) -> Column:
        first = F.greatest(s["start"] - REACH - 1, F.lit(0).cast("long"))
        before = F.substring(text, (first + 1).cast("int"), (s["start"] - first).cast("int"))
        before = F.when(s["start"] > REACH, F.regexp_replace(before, rf"^{_IN_WORD}+", "")).otherwise(before)
        before = F.element_at(F.split(before, "\n"), -1)
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(REACH + 1))
        after = F.when(F.char_length(after) > REACH, F.regexp_replace(after, rf"(?<!{_IN_WORD}){_IN_WORD}++\z", "")).otherwise(after)
        after = F.element_at(F.split(after, "\n"), 1)
        return F.struct(
            F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"),
            F.transform(
                F.filter(spans, lambda t: (t["end"] > s["start"] - REACH) & (t["start"] < s["end"] + REACH)),
                lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")),
            ).alias("taken"),
            F.array(
                F.struct((s["start"] - F.char_length(before)).alias("at"), before.alias("body")),
                F.struct(s["end"].alias("at"), after.alias("body")),
            ).alias("sides"),
        )

    return F.transform(spans, sides)


def _apart(base: Column, start: Column, end: Column) -> Column:
    """Whether a stretch touches no base span."""
    return ~F.exists(base, lambda s: (s["start"] < end) & (start < s["end"]))


def _neighbours(found: DataFrame) -> DataFrame:
    """(doc_id, entity, context, word, start, end): words beside entities that are no part of any base span."""
    near = found.where(F.size("base") > 0).select("doc_id", F.explode("beside").alias("b"))
    near = near.select("doc_id", "b.taken", "b.entity", F.xxhash64("b.sides.body").alias("context"), F.explode("b.sides").alias("side"))
    near = near.select("doc_id", "taken", "entity", "context", F.col("side.at").alias("at"), F.explode(_matches(F.col("side.body"), WORD)).alias("w"))
    near = near.select("doc_id", "taken", "entity", "context", F.lower("w.value").alias("word"), (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"))
    return near.where(_apart(F.col("taken"), F.col("start"), F.col("end")) & ~F.col("word").isin(FUNCTION_WORDS)).drop("taken")


def _revealing(texts: DataFrame, near: DataFrame, generalise: float, remove: float, least: int) -> DataFrame:
    """(entity, word, action) of words that disclose too much of an entity, by counts over all texts."""
    met = near.groupBy("entity", "word").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc_id", "start").alias("met"))
    met = met.where(F.col("contexts") >= least)
    counts = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("word")).select(F.lower("word").alias("word"))
    counts = counts.groupBy("word").count().join(met.select("word").distinct(), "word", "left_semi")
    entities = near.groupBy("entity").agg(F.countDistinct("doc_id", "context").alias("of_entity"))
    total = texts.select(F.sum(F.size(F.split("text", r"\s+"))).alias("total"))
    both = met.join(counts, "word").join(entities, "entity").withColumn("total", total.scalar())
    given = F.least(F.col("met") / F.col("count"), F.lit(1.0))
    bits = F.log2(F.greatest(F.col("total") / F.col("of_entity"), F.lit(2.0)))
    share = 1 + F.log2(given) / bits
    action = F.when(share >= remove, "remove").when(share >= generalise, "generalise")
    return both.select("entity", "word", action.alias("action")).where("action is not null")


def _terms(texts: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, key, terms): all words of all texts that reveal any entity, but for parts of base spans."""
    words = cut(rules.groupBy("word").agg(F.max("action").alias("action")))
    bits = _bits(words, F.xxhash64("word"))
    places = _matches(F.col("text"), WORD, lambda value: _passes(bits, F.xxhash64(F.lower(value))))
    hits = texts.where("doc_id is not null").select("doc_id", "key", F.explode(places).alias("w"))
    hits = hits.select("doc_id", "key", F.lower("w.value").alias("word"), "w.start", "w.end").join(words, "word")
    hits = hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "action"))).alias("terms"))
    base = found.where("doc_id is not null").select("doc_id", "key", "base").dropDuplicates(["doc_id", "key"])
    return hits.join(base, ["doc_id", "key"]).select("doc_id", "key", F.filter("terms", lambda t: _apart(F.col("base"), t["start"], t["end"])).alias("terms"))


def find_pii(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    least: int = LEAST_CONTEXTS,
) -> DataFrame:
    """(doc_id, base, terms) of every row: base spans (kind, start, end, value), and words that reveal them.

    `terms` (start, end, action) are by start: every place of every word that reveals some entity, be it beside one or
    not, unless it is part of a base span. Counts are taken over all texts, copies included; that word and entity
    meet in `least` different surroundings is asked for besides, so that copies of one text prove nothing. Null text:
    empty, no spans. Rows with a null id get base spans only. Repeated rows get the same spans. Other columns are
    ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))  # tells texts of a repeated id apart
    spans = rows.withColumn("base", base_spans(F.col("text")))
    found = cut(spans.select("doc_id", "key", "base", _beside(F.col("text"), F.col("base")).alias("beside")))
    near = cut(_neighbours(found))
    rules = _revealing(rows, near, generalise, remove, least)
    out = found.select("doc_id", "key", "base").join(_terms(rows, found, rules), ["doc_id", "key"], "left")
    return out.select("doc_id", "base", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")).alias("terms"))


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """`docs`, all columns, with entities replaced by their kinds, revealing words generalised or removed.

    Ids must be unique but for repeated rows; null ids keep their texts. Spans that overlap an earlier one are part of it.
    """
    found = find_pii(docs, id_column, text_column, **options).where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    tagged = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag")))
    words = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[WORD]").alias("tag")))
    key, spans = free_name(docs, "_doc_id"), free_name(docs, "_spans")
    found = found.select(F.col("doc_id").alias(key), F.sort_array(F.concat(tagged, words)).alias(spans))
    text = F.col(text_column)

    def put(acc: Column, s: Column) -> Column:
        part = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], part, s["tag"]).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(new)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    clean = F.when(F.col(spans).isNull() | (F.size(spans) == 0), text).otherwise(clean)
    joined = docs.join(found, F.col(id_column).cast("long") == F.col(key), "left")
    return joined.select(*(clean.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns))
