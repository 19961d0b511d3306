"""The n-gram join where an id has several texts."""

from tests.llm.frames import WORDS, docs, rows
from webmetrics.llm import ngram_join

A, B, C = (" ".join(f"{w}{k}" for w in WORDS) for k in "abc")
NEAR_A = A + " more"


def found(spark, table):
    return sorted(set(rows(ngram_join.ngram_components(docs(spark, table)), "doc_id", "component_id")))


def test_an_id_links_its_texts(spark):
    assert found(spark, [(5, A), (5, B), (7, B), (8, B)]) == [(5, 5), (7, 5), (8, 5)]
    assert found(spark, [(5, B), (5, A), (8, A), (7, B), (9, NEAR_A), (3, C)]) == [(3, 3), (5, 5), (7, 5), (8, 5), (9, 5)]
    assert found(spark, [(5, A), (5, B), (2, A), (9, B)]) == [(2, 2), (5, 2), (9, 2)]
    assert found(spark, [(5, A), (5, A), (6, A), (5, None), (4, "")]) == [(4, 4), (5, 5), (6, 5)]
