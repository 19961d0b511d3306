"""Revealing words planted in a corpus: how many are found, and what else is taken for one; rules by plain counts."""

import random

import numpy as np

from tests.llm.frames import docs
from webmetrics.llm import pii


def corpus(seed=5, entities=60):
    draw = random.Random(seed)
    common = [f"{a}{b}{c}" for a in ("the", "of", "an", "re") for b in ("ing", "ed", "or", "al") for c in ("", "s", "ly")]
    texts, planted = [], {}

    def prose(n):
        return " ".join(draw.choice(common) for _ in range(n))

    for e in range(entities):
        mail, alias = f"person{e}@mail.example.com", f"alias{chr(97 + e % 26)}{chr(97 + e // 26)}q"
        planted[alias] = mail
        texts += [f"{prose(8)} {alias.title()} {prose(3)} {mail} {prose(6)}\n{prose(20)}" for _ in range(5)]
        texts += [f"{prose(10)} {alias} {prose(10)}" for _ in range(draw.randrange(0, 3))]  # it stands elsewhere, too
    texts += [prose(60) for _ in range(300)]
    draw.shuffle(texts)
    return list(enumerate(texts)), planted


def test_planted_words_are_found(spark):
    pairs, planted = corpus()
    text = dict(pairs)
    found = {(r["doc_id"], t["start"], t["end"]) for r in pii.find_pii(docs(spark, pairs)).collect() for t in r["terms"]}
    wanted = {(i, at, at + len(alias)) for i, t in pairs for alias in planted if (at := t.lower().find(alias)) >= 0}
    recall = len(found & wanted) / len(wanted)
    print(f"recall {recall:.3f} of {len(wanted)}, {len(found - wanted)} others of {len(found)}")
    assert recall >= 0.9 and len(found - wanted) <= 0.02 * len(found), {text[i][a:b] for i, a, b in found - wanted}


def test_rules_follow_the_counts(spark):
    """A word is revealing exactly where log2 p(e|t) leaves at least the given share of the entity's bits."""
    pairs, planted = corpus(seed=6, entities=12)
    for share in (0.5, 0.97, 0.999):
        found = {(r["doc_id"], t["start"]) for r in pii.find_pii(docs(spark, pairs), generalise=share, remove=1.1).collect() for t in r["terms"]}
        total = sum(len(t.split()) for _, t in pairs)
        for alias, mail in planted.items():
            at = [(i, t.lower().find(alias)) for i, t in pairs if alias in t.lower()]
            beside = sum(mail in t for _, t in pairs if alias in t.lower())
            value = 1 + np.log2(beside / len(at)) / np.log2(total / beside)
            assert (set(at) <= found) == (value >= share) and (not set(at) & found) == (value < share)
