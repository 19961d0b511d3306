"""Line dedup's pairs do not grow with the square of what the corpus holds."""

import random

import pytest

from webmetrics.llm import line_dedup

VOCABULARY = [f"w{k}" for k in range(2500)]


@pytest.fixture
def counted(monkeypatch):
    """Rows of the pairs that are joined and of those whose words are compared."""
    made = {"_sharing": 0, "_verified": 0}
    sharing, verified = line_dedup._sharing, line_dedup._verified

    def joined(*args):
        out = line_dedup.cut(sharing(*args))
        made["_sharing"] += out.count()
        return out

    def compared(docs, pairs, percent):
        made["_verified"] += pairs.count()
        return verified(docs, pairs, percent)

    monkeypatch.setattr(line_dedup, "_sharing", joined)
    monkeypatch.setattr(line_dedup, "_verified", compared)
    return made


def gone(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in line_dedup.repeated_lines(docs).collect())


def expected(lines):
    sets = [set(line.split()) for line in lines]
    return [k for k, b in enumerate(sets) if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[:k])]


def test_middling_groups_are_not_paired_out(spark, counted):
    base = VOCABULARY[:40]
    copies = [" ".join(base[:k % 40] + [f"own{k}"] + base[k % 40 + 1:]) for k in range(60)]
    assert gone(spark, copies) == expected(copies) == list(range(1, 60))
    assert counted["_verified"] <= 60 * 8


def test_long_unlike_lines_are_told_apart(spark, counted):
    draw = random.Random(5)
    lines = [" ".join(draw.sample(VOCABULARY, 150)) for _ in range(120)]
    lines += [" ".join([*line.split()[:-9], "x"]) for line in lines[:10]]
    assert gone(spark, lines) == expected(lines) == list(range(120, 130))
    assert counted["_sharing"] < 200
