"""Links of the n-gram join: all of them are counted, and every different text takes part."""

import random

import pytest

from tests.llm.frames import WORDS, docs, rows
from webmetrics.llm import ngram_join


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2)) or (frozenset([tuple(words)]) if words else frozenset())


def links(texts):
    sets = [shingles(t) for t in texts]
    return {t: sum(100 * len(a & b) >= 90 * len(a | b) for b in set(sets) if a and b and a != b) for t, a in zip(texts, sets, strict=True)}


def copies(count, length=120):
    draw = random.Random(count)
    base = [draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(length)]
    out = []
    for k in range(count):
        own = list(base)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(length)] = f"n{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 1000])
def test_all_links_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = copies(60) + copies(5, 80) + copies(2, 200)
    table = [(k, t) for k, t in enumerate(texts)] + [(900, texts[3]), (901, None), (902, "one")]
    found = ngram_join.ngram_components(docs(spark, table))
    expected = links([t for _, t in table if t])
    assert rows(found, "doc_id", "n_links") == sorted(((i, expected.get(t, 0)) for i, t in table), key=repr)


def test_five_alike_texts(spark):
    base = " ".join(f"{w}{k}" for w in WORDS for k in range(8))
    table = [(k, f"{base} end{k}") for k in range(5)]
    assert rows(ngram_join.ngram_components(docs(spark, table)), "doc_id", "component_id", "n_links") == [(k, 0, 4) for k in range(5)]


def test_every_text_of_a_repeated_id_takes_part(spark):
    a, b, c = (" ".join(f"{w}{k}" for w in WORDS) for k in "abc")
    table = [(5, a), (5, b), (5, c), (7, a + " more"), (8, b + " more"), (9, c + " more")]
    found = rows(ngram_join.ngram_components(docs(spark, table)), "doc_id", "component_id", "n_links")
    assert found == [(5, 5, 1)] * 3 + [(k, 5, 1) for k in (7, 8, 9)]


def test_a_row_without_id_links_others(spark):
    words = [f"{w}{k}" for w in WORDS for k in range(4)]
    first, middle, last = (" ".join([f"x{k}" for k in range(n)] + words[n:]) for n in (0, 4, 6))
    table = [(3, first), (None, middle), (4, last), (None, "alone by itself here")]
    found = rows(ngram_join.ngram_components(docs(spark, table)), "doc_id", "component_id", "n_links")
    assert found == sorted([(3, 3, 1), (None, 3, 2), (4, 3, 1), (None, None, 0)], key=repr)
