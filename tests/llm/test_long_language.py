"""Language margins do not depend on length."""

import random

import pytest

from quarrykit.llm import compress_lang

LETTERS = {"xa": "aeioulmnrst", "xb": "aeoukzjvdgp"}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    words = {x: ["".join(rng.choices(c, k=rng.randint(2, 9))) for _ in range(4000)] for x, c in LETTERS.items()}
    common = words["xa"][:2000]
    words["xb"] = common + words["xb"][:2000]  # half of the words are shared
    said = lambda x, n: " ".join(rng.choices(words[x], k=n))
    rows = [(x, said(x, 600)) for x in LETTERS for _ in range(60)]
    return compress_lang.Classifier(compress_lang.build_dictionaries(rows), dict.fromkeys(LETTERS, 60)), said


@pytest.mark.parametrize("lang", sorted(LETTERS))
def test_margin_keeps_with_length(model, lang):
    m, said = model
    text = said(lang, 900_000)
    short = m.predict(text[:30_000])
    for size in (100_000, 1_000_000, 2_000_000, 5_000_000):
        x, score, margin = m.predict(text[:size])
        assert x == lang and margin >= 0.005 and margin > short[2] / 2 and score > 0.5


def test_blocks_are_whole():
    for raw in (b"", b"a", b"ab " * 50, b"x" * 95, b" " * 31, b"word " + b"y" * 40 + b" end"):
        parts = list(compress_lang._cut(raw, 10))
        assert b"".join(parts) == raw and all(len(x) <= 10 for x in parts)
