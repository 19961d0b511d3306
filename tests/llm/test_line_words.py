"""Line dedup reads the words of a line once, and splits a text once."""

import re

from pyspark.sql import functions as F

from webmetrics.llm import line_dedup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    levels = spark.range(1).select(F.array_repeat(F.lit(0).cast("tinyint"), line_dedup.COUNTERS).alias("levels"))
    sets = line_dedup._sets(docs, levels, 80, 5)
    assert plan(sets).count("lambdafunction(xxhash64(") == 1
    assert sets.count() == 1


def test_texts_are_not_split_for_each_line(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx"), (2, "y\na b c d e\nz")], "doc_id long, text string")
    kept = line_dedup.dedup_lines(docs)
    assert not re.search(r"lambdafunction\([^)]*split\(", plan(kept))
    assert sorted(kept.collect()) == [(1, "a b c d e\nx", 0), (2, "y\nz", 1)]


def test_every_blank_parts_words(spark):
    lines = ["a b c d e", "A\tb\x0bC\fd\re", " a  b\t\tc d \r e\f", "a\xa0b c d e f", "a\xa0b c d e\x1ff", "\x0b\f\t\r"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup.repeated_lines(docs).collect()) == [1, 2]


def test_sets_pass_over_words_few_times(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    levels = spark.range(1).select(F.array_repeat(F.lit(0).cast("tinyint"), line_dedup.COUNTERS).alias("levels"))
    text = plan(line_dedup._sets(docs, levels, 80, 5))
    assert len(re.findall(r"\b(?:transform|aggregate|filter)\(", text)) <= 5
