"""Texts for the tests of the text operators."""

import random


def sentence(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = sentence(1, 120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    line = "This very line of text is long enough to be looked at."
    return [
        (0, base, "en", "a"), (1, base.upper(), "en", "a"), (2, near, None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n ", "de", "b"),
        (6, "one two", "de", "b"), (6, "one two", "de", "b"), (None, "one two", "de", None), (7, "¿qué? 日本語 123 ...", "es", "c"),
        (8, sentence(2, 30_000), "en", "c"), (9, "\n".join([line] * 3 + ["tail 9"]), "en", "a"), (10, f"  {line.upper()}\t\nx", "en", "a"),
        (11, line, "en", None), (12, line + "\n" + line, "en", "a"), (13, line + "\r\nshort", None, "a"), (14, "a " * 200, "en", "d"), (15, "x" * 5000, "en", "d"),
    ]
