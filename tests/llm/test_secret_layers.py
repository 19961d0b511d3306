"""Secrets in layers against a plain recursive decoder; places inside base64; long unpacked lines."""

import base64
import gzip
import random
import re
import resource
import urllib.parse
import zlib

import pytest

from webmetrics.llm import secrets

SECRETS = ["password=abcdefghijklmnop", "AKIA" + "Z9" * 8, "0123456789abcdef", "api_key: 'Zm9vYmFyYmF6cXV4'"]


def kinds(text):
    return sorted({k for k, _, _ in secrets.scan(text)})


def plain_decoder(text, depth=0):
    """Kinds of secrets in a text and in whatever all of it, or a word of it, decodes to."""
    found = set(kinds(text))
    if depth > 6:
        return found
    below = []
    if "%" in text:
        below.append(urllib.parse.unquote(text))
    if "\\" in text:
        below.append(re.sub(r"\\U([0-9a-f]{8})|\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1) or m.group(2), 16)), text))
    for word in text.split():
        if re.fullmatch(r"[A-Za-z0-9+/]{16,}={0,2}", word) and len(word) % 4 == 0:
            raw = base64.b64decode(word)
            try:
                raw = zlib.decompress(raw, 47)
            except zlib.error:
                pass
            below.append(raw.decode("utf-8", "replace"))
    for layer in below:
        if layer != text:
            found |= plain_decoder(layer, depth + 1)
    return found


WRAPS = [
    lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    lambda t: base64.b64encode(zlib.compress(t.encode())).decode(), lambda t: "".join(f"%{b:02x}" for b in t.encode()),
    lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
]


@pytest.mark.parametrize("seed", range(60))
def test_finds_what_a_plain_decoder_finds(seed):
    draw = random.Random(seed)
    text = f"so {draw.choice(SECRETS)} é" if seed % 4 else "nothing to see é here at all"
    for _ in range(draw.randrange(1, 4)):
        text = draw.choice(WRAPS)(text)
        text = draw.choice(["", "see "]) + text + draw.choice(["", " end", "\nend"])
    wanted = plain_decoder(text)
    found = {s[0] for s in secrets.spans_of(text)}
    assert wanted <= found and (seed % 4 == 0 or wanted)


def test_secrets_of_one_run_have_places_of_their_own():
    inner = "first password=abcdefghijklmnop then é AKIA" + "Q7" * 8 + " and token=qrstuvwxyzabcd end"
    for lead in ("", "x: ", "é "):
        for width in (None, 40):
            code = base64.b64encode(inner.encode()).decode()
            run = code if width is None else "\n".join(code[k : k + width] for k in range(0, len(code), width))
            text = f"{lead}{run}\n"
            spans = [s for s in secrets.spans_of(text) if s[3] == "base64"]
            ranges = {s[:3] for s in spans}
            assert {(kind, len(lead), len(lead) + len(run)) for kind in ("assign", "access")} <= ranges
            place = [k for k, c in enumerate(run) if c != "\n"]
            for kind, secret in (("assign", "password=abcdefghijklmnop"), ("access", "AKIA" + "Q7" * 8), ("assign", "token=qrstuvwxyzabcd")):
                at = len(inner[: inner.index(secret)].encode())
                first, last = at // 3 * 4 + at % 3, (at + len(secret) - 1) // 3 * 4 + (at + len(secret) - 1) % 3 + 2
                assert (kind, len(lead) + place[first], len(lead) + place[last - 1] + 1) in ranges
            assert width or len(ranges) == 5  # lines of a wrapped run are runs themselves


def test_escapes_of_eight_digits():
    text = "\\U00000041\\U0000004bIA" + "ABCDEFGHIJKLMNOP"
    assert ("access", 0, len(text), "unicode") in secrets.spans_of(text)
    assert secrets.spans_of("\\UFFFFFFFF \\U0001F600 \\U00110000") == []


def test_long_lines_are_unpacked_in_bounded_memory():
    """A line of 300 MB without a break, a secret near its end: found, in a few dozen MB."""
    engine = zlib.compressobj(9)
    raw = b"".join(engine.compress(b" " * (1 << 20)) for _ in range(300))
    raw += engine.compress(b" password=abcdefghijklmnop ") + engine.flush()
    text = base64.b64encode(raw).decode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [s[:3] for s in secrets.spans_of(text)] == [("assign", 0, len(text))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000
