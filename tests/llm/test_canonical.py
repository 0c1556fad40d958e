"""Canonical tokens of decontamination against a plain version, and what they cost."""

import random
import re
import time

import numpy as np
import pytest

from dipstick.llm import decontaminate
from dipstick.llm.decontaminate import NAME, NUMBER, STOP, UNIT, UNITS, WORD, Canonical

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
ODD = list("aAbB127..,,!?\n  _²½ⅫςσΣİıſkKgG٣४éÉ漢字\0-") + ["K", "̇", "12 km ", "Km", "3 Days", "hours", "\U0001d7d9", "ᾈ", "ǅ", "ŉ", "ß", "ẞ", "Ⓐ"]


@pytest.fixture(scope="module")
def canon():
    return Canonical()


def plainly(texts):
    """(token, document, kind, number or unit word, plain form, form with names) of every token but sentence ends."""
    out = []
    for doc, text in enumerate(texts):
        before = STOP
        for token in TOKEN.findall(text):
            kind = STOP if token in decontaminate.ENDS else NUMBER if token[0].isdigit() else UNIT if token.lower() in UNITS else NAME if token[0].isupper() else WORD
            typed = kind in (NUMBER, UNIT)
            used = WORD if (kind == NAME and before == STOP) or (kind == UNIT and before != NUMBER) else kind
            before = kind
            plain_form = f"\0{used}" if used in (NUMBER, UNIT) else token.lower()
            if kind != STOP:
                out.append((token, doc, used, typed, plain_form, "\0name" if used == NAME else plain_form))
    return out


def check(canon, texts, exact=True):
    begins, ends, doc, plain, named, own, kind, typed = canon(texts)
    text, want = decontaminate.joined(texts), plainly(texts)
    tokens = [text[b:e] for b, e in zip(begins, ends)]
    assert list(zip(tokens, doc, kind, typed)) == [w[:4] for w in want]
    for hashes, forms in ((plain, [w[4] for w in want]), (named, [w[5] for w in want]), (own, [w[0].lower() for w in want])):
        assert len(set(zip(forms, hashes.tolist()))) == len(set(forms))  # equal forms, equal hashes
        if exact:
            assert len(set(hashes.tolist())) == len({f.replace("ς", "σ") for f in forms})


def test_tokens_of_odd_texts(canon):
    for texts in ([], [""], ["", ""], ["."], ["1.", ".1", "1,2.3", "1..2", "1.a", "a.1", "1.\n2", "1", "2"], ["5 km", "km 5", "5. km", "5", "km"]):
        check(canon, texts)
    rng = random.Random(5)
    for _ in range(200):
        check(canon, ["".join(rng.choices(ODD, k=rng.randrange(60))) for _ in range(rng.randrange(1, 20))])


def test_every_code_point(canon):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    check(canon, ["".join(points), " ".join(points), *(c + c.lower() + c.upper() + "." + c for c in points if c.isalnum() and c.lower() != c.upper())], exact=False)


def test_blocks_of_runs_and_long_words(canon, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abc1.", k=rng.choice((1, 3, 40, 3000)))) for _ in range(50)) for _ in range(4)]
    whole = canon(texts)
    monkeypatch.setattr(decontaminate, "RUNS", 7)
    assert all((a == b).all() for a, b in zip(whole, canon(texts)))
    check(canon, texts)


def test_new_words_cost_less_than_their_pattern(canon):
    """A corpus always brings new words: cutting and hashing them must stay below what the pattern alone takes to cut them."""
    rng = np.random.default_rng(7)
    letters = rng.integers(97, 123, (200_000, 6), np.uint8)
    letters[:, 5] = 32
    texts = [part.tobytes().decode() for part in np.array_split(letters, 200)]

    def seconds(call):
        def once():
            start = time.process_time()
            call()
            return time.process_time() - start

        return min(once() for _ in range(3))

    assert seconds(lambda: canon(texts)) < seconds(lambda: [TOKEN.findall(t) for t in texts])
