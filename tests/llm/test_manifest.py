"""Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import docs, edges, empty
from webmetrics.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, **changed):
    values = [{**row, **changed}[name] for name in ("doc_id", "source", "lang", "n_chars", "text")]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def path(levels, at):
    found = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        found.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= 16
    return found


def audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    whole = tree([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for rank, row in enumerate(groups[name]):
            way = path(trees[name], rank) + path(whole, place)
            number = "" if row["doc_id"] is None else str(row["doc_id"])
            text = row["text"]
            if zlib.crc32(number.encode()) % 5 == 0 and text is not None:
                text = text.translate(LOWER)
            folded = leaf(row, text=text)
            for before, after in way:
                folded = h(before, folded, after)
            root = whole[-1][0]
            out.append((row["doc_id"], leaf(row), trees[name][-1][0], root,
                        h(*[a + b for a, b in way]), folded, folded == root))
    return sorted(out, key=repr)


def same(df):
    expected = audit([r.asDict() for r in df.collect()])
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == expected
    return expected


def test_trees_of_all_heights(spark):
    # Trees of 0, 1, 2 and 3 levels; 18 sources make two levels above them; one source has no name.
    sizes = {None: 3, "a": 1, "é": 16, "Z": 17, "many": 300, **{f"s{k}": 1 for k in range(13)}}
    rows = [(source, k) for source, size in sizes.items() for k in range(size)]
    df = spark.createDataFrame(
        [(i * 7 % 1000, f"Text {k} É" if k % 9 else None, "en" if k % 4 else None, source, k if k % 5 else None)
         for i, (source, k) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long")
    found = same(df.repartition(5))
    assert {row[-1] for row in found} == {True, False}


def test_repeated_rows_nulls_and_other_columns(spark):
    found = same(edges(spark))
    assert len(found) == edges(spark).count()


def test_one_row_and_none(spark):
    (row,) = same(docs(spark, [(1, "One")]))
    assert row[1] == row[2] == row[3] and row[4] == hashlib.sha256(b"").hexdigest()
    assert merkle.audit(empty(spark)).count() == 0


def test_records_are_addressed_by_content(spark):
    """Equal runs are one record, and every proof's digest occurs in it."""
    rows = [(1, "same")] * 40
    made = merkle.manifest(docs(spark, rows))
    assert [r.count() for r in made.sources.records] == [2, 1]  # 16 + 16 equal leaves, then 8; above them 3 children
    assert len(same(docs(spark, rows))) == 40


@pytest.mark.parametrize("text, lower", [("ABC é É", "abc é É"), ("", ""), (None, None)])
def test_only_ascii_capitals_change(spark, text, lower):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(merkle.lower_ascii(F.col("text"))).first()[0] == lower
