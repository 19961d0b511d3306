"""Phrase counts and collocations against plain counting; the FM-index against a list."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import edges, empty
from webmetrics.llm import collocations, fm_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def expected(rows, least, best):
    out = []
    by = defaultdict(list)
    for lang, text in rows:
        by["und" if lang is None else lang] += pieces(text)
    for lang, found in by.items():
        f = Counter(tuple(p[i : i + k]) for p in found for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
        n = sum(map(len, found))
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longest = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longest[g[i : i + k]] = max(longest[g[i : i + k]], a)
        ranked = []
        for g, a in candidates.items():
            if longest[g] and 100 * longest[g] >= 80 * a:
                continue
            low, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-low, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def same(df, least, best=2000):
    found = sorted(map(tuple, collocations.collocations(df, least, best).collect()))
    assert found == expected([(r["lang"], r["text"]) for r in df.select("lang", "text").collect()], least, best)
    return found


def prose(seed, texts, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["A", "a", "É", "é", "Zz", "漢字"]
    out = []
    for _ in range(texts):
        text = []
        for _ in range(rng.randrange(60)):
            text.append(rng.choice(vocabulary[: rng.randrange(1, len(vocabulary))]))
            if rng.random() < 0.2:
                text.append("Fixed phrase of Four")
            text.append(rng.choice([" ", "  ", "\t", " \t ", ".", ", ", "\n", "\r\n", "!?", " ", "\x0b"]))
        out.append("".join(text))
    return out


@pytest.mark.parametrize("shard", [40, 1 << 21])
def test_against_plain_counts(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 10 * shard)
    langs = ["en", "de", None, "und", "en"]
    rows = [(langs[k % 5], text) for k, text in enumerate(prose(1, 300, 12))]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert len(same(df, 3)) > 100
    assert len(same(df, 3, best=5)) == 15  # three languages: null is und


def test_texts_of_one_word_and_breaks(spark):
    rows = [("en", "a a a a a a")] * 4 + [("en", "a.a,a;a")] * 3 + [("fr", "x"), ("fr", None), ("fr", "..."), ("fr", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {r[2] for r in same(df, 4)} == {"a a a", "a a a a"}  # "a a" has "a a a" 80 % of the time


def test_edges(spark):
    assert same(edges(spark), 2)
    same(edges(spark).withColumn("phrase", F.lit("x")).withColumn("shard", F.lit(1)), 30)
    assert collocations.collocations(empty(spark)).count() == 0


def test_scores_pass_64_bits(spark):
    a = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(a, a, 3)], "a long, l long, r long").select(
        collocations.score(F.col("a"), F.col("l")).alias("x"), collocations.score(F.col("a") - 1, F.col("l")).alias("y"),
        collocations.score(F.col("r"), F.col("l")).alias("z")).first()
    assert tuple(row) == (2_000_000, 1_999_999, 0)


def test_words_of_texts():
    words, of = collocations.split_words(pa.array(["Ab\tcd  É.x", "", "a!!b"]))
    kept = [(w, t) for w, t in zip(words.to_pylist(), of.tolist()) if w]
    assert kept == [("ab", 0), ("cd", 0), ("É", 0), ("\n", 0), ("x", 0), ("\n", 0), ("\n", 1),
                    ("a", 2), ("\n", 2), ("\n", 2), ("b", 2), ("\n", 2)]


@pytest.mark.parametrize("seed", range(5))
def test_intervals(seed):
    """Extensions to both sides, in any order, have the counts of a plain search, and their intervals have their size."""
    rng = np.random.default_rng(seed)
    words = np.concatenate(([0], rng.integers(0, 5, 400), [0])).astype(np.int32)
    text = words.tolist()
    index = fm_index.Index(np.bincount(words), fm_index.transform(words), fm_index.transform(words[::-1]))
    level = [((w,), index.words(np.array([w]))) for w in range(1, 5)]
    for size in range(1, 4):
        after = []
        for phrase, interval in level:
            for side in ("left", "right"):
                found = getattr(index, side)(interval)
                plain = Counter()
                for i in range(len(text) - size):
                    whole = tuple(text[i : i + size + 1])
                    if 0 not in whole and (whole[1:] if side == "left" else whole[:-1]) == phrase:
                        plain[whole] += 1
                longer = [(w, *phrase) if side == "left" else (*phrase, w) for w in found.word.tolist()]
                assert dict(zip(longer, found.phrases.count.tolist())) == dict(plain)
                after += [(p, found.phrases[np.array([k])]) for k, p in enumerate(longer)]
        level = after
    by_phrase = defaultdict(set)
    for phrase, i in level:
        by_phrase[phrase].add((int(i.low[0]), int(i.back[0]), int(i.count[0])))
    assert all(len(places) == 1 for places in by_phrase.values())  # the way to a phrase does not matter
