"""Line duplicates by an exact set-similarity join, in DataFrame functions only.

Lines are sets of words. Words are ordered from rare to common; two sets that are alike enough share a word among
the first few of each, long ones several, so only those few are joined. Length, positions and parity sketches thin
the pairs, the words themselves decide, and of two lines that are alike the later one goes. Before that, lines of
groups of near copies are compared with a few of their group, and what goes by this is no later line of any pair.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

PERCENT = 80
#: Lines with fewer different words are left alone, exact copies too, as the query's SQL has it.
LEAST_WORDS = 5
#: Counters of word frequency, whatever the vocabulary is.
COUNTERS = 1 << 19
#: Longs of a membership filter that thins rows before a join.
FILTER_LONGS = 1 << 16

#: Sets of so many words have a sketch of two further longs: among that many words, one of 64 bits tells few sets apart.
WIDE = 80
#: Lines that share such a pair are a group from so many on, whatever the corpus holds.
CROWD = 16
#: So many lines lead a group, each other line is compared with so many of them, in so many turns, before all pairs of what is left.
LEADERS, NEAREST, TURNS = 16, 4, 2
#: Parts of the words that are joined one after the other.
PASSES = 4

_BLANKS = "\t\x0b\f\r"  # white space within a line, besides the space


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


def _filter(keys: DataFrame, key: Column) -> DataFrame:
    """A membership filter of `keys`, one row (bits: `FILTER_LONGS` longs).

    Plans read it as a scalar subquery, so it is no part of their text and is gone with them.
    """
    bit = F.pmod(key, F.lit(FILTER_LONGS * 64))
    longs = keys.select(F.shiftright(bit, 6).alias("id"), _left(F.lit(1).cast("long"), bit % 64).alias("v"))
    longs = longs.groupBy("id").agg(F.bit_or("v").alias("v"))
    return _row_of(longs, FILTER_LONGS, F.lit(0).cast("long"), "bits")


def _row_of(values: DataFrame, count: int, missing: Column, name: str) -> DataFrame:
    """One row with an array: `v` by `id`, from 0 to `count`."""
    every = values.sparkSession.range(count).join(values, "id", "left").select(F.struct("id", F.coalesce("v", missing).alias("v")).alias("e"))
    return cut(every.agg(F.sort_array(F.collect_list("e")).alias("all")).select(F.col("all.v").alias(name)))


def _passes(bits: DataFrame, key: Column) -> Column:
    bit = F.pmod(key, F.lit(FILTER_LONGS * 64))
    return _right(F.get(bits.scalar(), F.shiftright(bit, 6).cast("int")), bit % 64).bitwiseAND(F.lit(1).cast("long")) != 0


def _split(body: Column) -> Column:
    """Words of a line, and empty ones where blanks follow one another."""
    # One blank after the other: Spark searches bytes for each, while `translate` makes a string of every character.
    # `contains` finds out faster than `replace` that a blank is not there.
    plain = body
    for blank in _BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    rare = reduce(or_, (F.contains(body, F.lit(blank)) for blank in _BLANKS))
    return F.split(F.lower(F.when(rare, plain).otherwise(body)), " ")


def _words(body: Column) -> Column:
    return F.array_remove(_split(body), "")


def _levels(texts: DataFrame) -> DataFrame:
    """Frequency of words in doublings, for each counter, counted over all texts: one row (levels: `COUNTERS` small numbers)."""
    # Of lines, as these seldom hold another blank than the space.
    lines = texts.select(F.explode(F.split("text", "\n")).alias("body"))
    words = lines.select(F.explode(_split(F.col("body"))).alias("word")).where("word != ''")
    counts = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(COUNTERS)).alias("id")).count()
    level = F.least(F.floor(F.log2("count")), F.lit(15))
    return _row_of(counts.select("id", level.cast("tinyint").alias("v")), COUNTERS, F.lit(0).cast("tinyint"), "levels")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, body): lines by number, from texts that have an id."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def _at_least(numerator: int, denominator: int, n: Column) -> Column:
    """ceil(n * numerator / denominator)."""
    return F.floor((n * numerator + denominator - 1) / denominator).cast("int")


def _hashes(words: Column) -> Column:
    """Hashes of the different words, in their order."""
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _tokens(hashes: Column, levels: Column) -> Column:
    """Words' places in the order: frequency level, then 28 bits of the hash.

    Words that fall together only give pairs that the words themselves refute.
    """

    def bits(hashed: Column, count: int) -> Column:
        return hashed.bitwiseAND(F.lit((1 << count) - 1).cast("long")).cast("int")

    def token(hashed: Column) -> Column:
        level = F.get(levels, bits(hashed, COUNTERS.bit_length() - 1)).cast("int")
        return _left(level - 8, F.lit(28)).bitwiseOR(bits(hashed, 28))

    return F.transform(hashes, token)


def _common(n: Column) -> Column:
    """How many of their first words two sets must share, if the shorter one has `n` words; their beginnings grow with it."""
    return F.shiftright(n, 5) + 1


def _sets(docs: DataFrame, levels: DataFrame, percent: int, least: int) -> DataFrame:
    """(doc_id, line, n, k1, k2, sketch, wide0, wide1, ends, start): each line's set by a 128-bit key, its least and greatest hashes, and its first words."""
    # A subquery that is read once: the table is no part of the plan's text, and Spark puts it where it is used.
    lines = _lines(docs).where(F.col("body").rlike(r"[^\x20\x09\x0B-\x0D]"))
    # Exploded, so that words are read once: Spark would move the condition on `n`, hashes and all, below the projection.
    rows = lines.select("doc_id", "line", F.explode(F.array(_hashes(_words(F.col("body"))))).alias("hashes"))
    rows = rows.withColumn("n", F.size("hashes")).where(F.col("n") >= least).withColumn("levels", levels.scalar())
    rows = rows.select("doc_id", "line", "n", "hashes", _tokens(F.col("hashes"), F.col("levels")).alias("tokens"))
    rows = rows.select("doc_id", "line", "n", "hashes", F.explode(F.array("tokens")).alias("tokens"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def flips(tokens: Column, by: int) -> Column:
        # Shifts take the last six bits of what they shift by.
        return F.aggregate(tokens, zero, lambda acc, token: acc.bitwiseXOR(_left(one, F.shiftright(token, by) if by else token)))

    # Words of negative hashes, which come first, and the others have a sketch each.
    negative = F.array_position(F.sort_array(F.array_append("hashes", zero)), zero).cast("int") - 1
    wide = F.col("n") >= WIDE
    count = F.col("n") - _at_least(percent, 100, F.col("n")) + _common(F.col("n"))
    ends = F.concat(F.slice("hashes", 1, 2), F.slice("hashes", F.greatest(F.lit(1), F.col("n") - 1), F.lit(2)))
    return rows.select(
        "doc_id",
        "line",
        "n",
        F.xxhash64("hashes").alias("k1"),
        F.xxhash64(F.lit(1), "hashes").alias("k2"),
        flips(F.col("tokens"), 0).alias("sketch"),
        F.when(wide, flips(F.slice("tokens", 1, negative), 6)).alias("wide0"),
        F.when(wide, flips(F.slice("tokens", negative + 1, F.col("n")), 6)).alias("wide1"),
        ends.alias("ends"),
        F.slice(F.sort_array("tokens"), 1, count).alias("start"),
    )


def _pair(left: Column, right: Column) -> list[Column]:
    return [left["doc"].alias("a_doc"), left["line"].alias("a_line"), right["doc"].alias("b_doc"), right["line"].alias("b_line")]


def _close(n: Column, m: Column, sketch: Column, other: Column, percent: int) -> Column:
    """Whether sizes and sketches allow two sets to be alike enough."""
    apart = F.bit_count(sketch.bitwiseXOR(other)) * (100 + percent) <= (n + m) * (100 - percent)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & apart


def _wide_close(x: str, y: str, percent: int) -> Column:
    """Whether the wide sketches, if both sets have one, allow two sets to be alike enough."""
    bits = sum(F.bit_count(F.col(f"{x}.wide{half}").bitwiseXOR(F.col(f"{y}.wide{half}"))) for half in (0, 1))
    return F.coalesce(bits * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent), F.lit(True))


def _crowds(first: DataFrame) -> DataFrame:
    """(key, doc, line, n, sketch): lines by pairs of their least and greatest hashes, of pairs that at least `CROWD` lines share.

    Large groups of near copies have such pairs. Their size decides, not how frequent their words are, so what is left
    to the join of all words does not grow with the square of the corpus.
    """
    ends = [F.element_at("ends", k) for k in (1, 2, -2, -1)]
    keys = F.array(*(F.xxhash64(F.lit(i), ends[i], ends[j]) for i, j in ((0, 1), (0, 3), (2, 3))))
    entries = first.select(F.explode(keys).alias("key"), "doc", "line", "n", "sketch")
    crowds = cut(entries.groupBy("key").count().where(F.col("count") >= CROWD).select("key"))
    return entries.where(_passes(_filter(crowds, F.col("key")), F.col("key"))).join(crowds, "key", "left_semi")


def _leaders(entries: DataFrame) -> DataFrame:
    """(key, a): the earliest `LEADERS` lines of each key."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("doc", "line"))
    first = entries.withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    return first.select("key", F.struct("doc", "line", "n", "sketch").alias("a"))


def _starred(entries: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each line and those `NEAREST` earlier leaders of its keys whose sketches are nearest.

    Most lines of large groups go by a comparison with a few lines each.
    """
    joined = entries.join(leaders, "key").where(_close(F.col("a.n"), F.col("n"), F.col("a.sketch"), F.col("sketch"), percent))
    joined = joined.where(F.struct("a.doc", "a.line") < F.struct("doc", "line"))
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col("a.sketch"))).alias("apart")
    nearest = F.slice(F.sort_array(F.collect_set(F.struct(apart, "a.doc", "a.line"))), 1, NEAREST)
    pairs = joined.groupBy("doc", "line").agg(nearest.alias("a")).withColumn("a", F.explode("a"))
    return pairs.select(*_pair(F.struct("a.doc", "a.line"), F.struct("doc", "line")))


def _alike(first: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b), a before b and b open still, of the first lines of all sets.

    Words are joined in `PASSES` parts, each kept before the next, so that only one part's entries lie on disk.
    """
    parts = None
    for part in range(PASSES):
        found = cut(_sharing(first, percent, part))
        parts = found if parts is None else parts.unionByName(found)
    shared = parts.groupBy("a_doc", "a_line", "b_doc", "b_line", "common").agg(F.sum("count").alias("count"))
    return shared.where("count >= common").drop("common", "count")


def _sharing(lines: DataFrame, percent: int, part: int) -> DataFrame:
    """Pairs that share first words of one part, how many of them, and how many they must share in all parts."""
    entries = lines.select(F.posexplode("start").alias("at", "token"), *(c for c in lines.columns if c != "start"))
    entries = entries.where(F.pmod("token", F.lit(PASSES)) == part)
    x, y = entries.alias("x"), entries.alias("y")
    n = F.col("x.n") + F.col("y.n")
    first = (F.col("x.doc") < F.col("y.doc")) | ((F.col("x.doc") == F.col("y.doc")) & (F.col("x.line") < F.col("y.line")))
    before, after = F.least("x.at", "y.at"), F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    # Of the shorter set fewer first words are enough: at < n - ceil(n * 2 * percent / (100 + percent)) + common.
    indexed = (F.col("x.at") + 1 - _common(F.col("x.n"))) * (100 + percent) <= F.col("x.n") * (100 - percent)
    joined = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.when(indexed, F.col("y.n")).otherwise(0) >= F.col("x.n"))  # names both sides, so that they stay one shuffle
        & _close(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent)
        & ((F.col("x.n") < F.col("y.n")) | first)
        & ((before + after) * (100 + percent) >= n * percent)
        & _wide_close("x", "y", percent)
        & F.when(first, F.col("y.open")).otherwise(F.col("x.open")),
    )
    ends = [F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(f"{e}_{c}") for e, a, b in (("a", "x", "y"), ("b", "y", "x")) for c in ("doc", "line")]
    pair = joined.select(*ends, _common(F.col("x.n")).alias("common"))
    return pair.groupBy("a_doc", "a_line", "b_doc", "b_line", "common").count()


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc, line) of pairs whose words really are alike enough."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")), F.struct(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")))).alias("e"))
    bits = _filter(ends.select("e.*"), F.xxhash64("doc", "line"))
    lines = _lines(docs).where(_passes(bits, F.xxhash64("doc_id", "line")))
    lines = lines.select("doc_id", "line", F.array_distinct(_words(F.col("body"))).alias("words"))
    a = lines.select(F.col("doc_id").alias("a_doc"), F.col("line").alias("a_line"), F.col("words").alias("a_words"))
    b = lines.select(F.col("doc_id").alias("b_doc"), F.col("line").alias("b_line"), F.col("words").alias("b_words"))
    both = pairs.join(a, ["a_doc", "a_line"]).join(b, ["b_doc", "b_line"])
    shared = F.size(F.array_intersect("a_words", "b_words"))
    good = both.where(shared * 100 >= percent * (F.size("a_words") + F.size("b_words") - shared))
    return good.select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")).distinct()


def repeated_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line) of every line of `docs` (doc_id, text) that an earlier one is alike to."""
    levels = _levels(docs)
    sets = cut(_sets(docs, levels, percent, least))
    place = F.min(F.struct("doc_id", "line")).alias("p")
    same = ["n", "sketch", "wide0", "wide1", "ends", "start"]
    first = sets.groupBy("k1", "k2").agg(place, *(F.first(c).alias(c) for c in same))
    first = cut(first.select(F.col("p.doc_id").alias("doc"), "p.line", "k1", "k2", *same))
    # Lines that repeat a set go whether its first line stays or not.
    places = first.select("k1", "k2", F.col("doc").alias("doc_id"), "line")
    repeats = cut(sets.select("k1", "k2", "doc_id", "line").join(places, ["k1", "k2", "doc_id", "line"], "left_anti").select("doc_id", "line").distinct())
    first = first.drop("k1", "k2")
    del sets, places  # its beginnings of sets are the largest part of what is kept
    later, entries = None, cut(_crowds(first))
    for _ in range(TURNS):
        leaders = cut(_leaders(entries))
        found = cut(_verified(docs, cut(_starred(entries, leaders, percent)), percent))
        led = leaders.select("key", "a.doc", "a.line")
        entries = cut(entries.join(led, ["key", "doc", "line"], "left_anti").join(found, ["doc", "line"], "left_anti"))
        later = found if later is None else later.unionByName(found)
    del entries, leaders, led
    closed = later.withColumn("closed", F.lit(True))
    first = cut(first.join(closed, ["doc", "line"], "left").withColumn("open", F.col("closed").isNull()).drop("closed", "ends"))
    later = later.unionByName(_verified(docs, cut(_alike(first, percent)), percent)).withColumnRenamed("doc", "doc_id")
    return later.unionByName(repeats).distinct()


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
    removed_column: str = "removed_lines",
) -> DataFrame:
    """`docs`, all columns, with repeated lines taken out of the text, and how many went in `removed_column`.

    Lines end at line feeds. A line's words are what other ASCII white space parts, in lower case, each counted
    once. A line goes if an earlier one (by id, then line number) is alike: 100 times the words in both is at least
    `percent` times the words in either, whether that earlier line stays or not. Lines with fewer than `least`
    different words stay, and blank lines whatever `least` is; 1 treats all other lines alike. A text of which nothing is left is empty.

    Null texts and rows with a null id stay as they are. Rows that repeat an id and text keep the same lines. A
    column named `removed_column` is replaced; others, whatever their names, stay.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    key, lost = free_name(docs, "_doc_id"), free_name(docs, "_gone")
    gone = repeated_lines(texts, percent, least).groupBy("doc_id").agg(F.collect_list("line").alias(lost))
    gone = cut(gone.withColumnRenamed("doc_id", key))
    bits = _filter(gone, F.xxhash64(key))
    hit = F.coalesce(_passes(bits, F.xxhash64(F.col(id_column).cast("long"))), F.lit(False)) & F.col(id_column).isNotNull()
    names = [c for c in docs.columns if c != removed_column]
    same = docs.where(~hit).select(*names, F.lit(0).alias(removed_column))
    changed = docs.where(hit).join(gone, F.col(id_column).cast("long") == F.col(key), "left")
    split = free_name(changed, "_lines")
    # Split once a text: written out inside the lambda, it would be split again for each line.
    changed = changed.withColumn(split, F.split(text_column, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost))
    text = F.array_join(F.transform(kept, lambda k: F.get(split, k)), "\n")
    text = F.when(F.col(lost).isNull(), F.col(text_column)).otherwise(text)
    size = F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost))
    changed = changed.select(*(text.alias(c) if c == text_column else F.col(f"`{c}`") for c in names), size.alias(removed_column))
    return same.unionByName(changed)
