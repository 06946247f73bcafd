import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "an") for b in ("re", "so", "ti", "du") for c in ("n", "s", "ra", "l", "")]


def prose(rnd, n):
    words = []
    while len(words) < n:
        sentence = [rnd.choice(WORDS) for _ in range(rnd.randrange(4, 12))]
        words += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(words[:n])


@pytest.fixture
def rnd():
    return random.Random(20)


ODD_TEXTS = [None, "", " ", "\n\n", "a", "one two three", "one two three four", "x " * 3000, "é" * 500, "日本語 テキスト", "A b\tc\x0bd e f", "🙂 " * 20, "\x00 \x1f", "the same words again and again " * 3]
