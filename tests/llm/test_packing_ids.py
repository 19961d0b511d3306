"""Ids of every letter, bare and before what ends a word, as the tokenizer gives them."""

import sys
import unicodedata
from array import array

from webmetrics.llm import packing


def test_ids_of_all_code_points():
    known = packing._Ids(packing.default_tokenizer())
    characters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    runs = [c + end for c in characters for end in ("", ".", ",")] + [f"a{c}." for c in characters] + [f"{c}a," for c in characters]
    wrong = []
    for at in range(0, len(runs), 5000):
        some = runs[at : at + 5000]
        for run, wanted in zip(some, known.tokenizer.encode_batch(some, add_special_tokens=False)):
            if known.of(run) != array("I", wanted.ids).tobytes():
                wrong.append(run)
    assert not wrong, (len(wrong), wrong[:20])
