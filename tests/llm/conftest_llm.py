"""Rows and paths shared by the tests of the training-data operators."""

import pytest

LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(6000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def body(k, n=30):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % 20] + str((k * 13 + i) % 11) for i in range(n))


#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, equal and near texts.
ROWS = [
    (1, body(1)), (2, body(2)), (3, body(1)), (4, body(1).replace(" ", "\t ", 1)), (5, ""), (6, None), (7, "   \n"), (8, LONG), (9, LONG + " tail"),
    (10, body(3, 60)), (11, body(3, 60) + " more"), (12, "one two"), (13, "One  TWO"), (14, "é ß Ω 日本 🙂, x. y!. z"), (14, "é ß Ω 日本 🙂, x. y!. z"),
    (15, "<|endoftext|> don't\tstop  now \n\nline,\nother."), (None, body(1)), (None, None), (16, body(9, 60) + "\n" + body(4) + "\n" + body(5)),
    (17, body(8, 50) + "\n" + body(4) + "\n" + body(5)),
]


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)
