import random
import re
import string

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r: random.Random, n: int, vocabulary: int = 300) -> str:
    words = [f"w{r.randrange(vocabulary)}" + r.choice(["", "", ",", "."]) for _ in range(n)]
    return "".join(w + r.choice([" ", " ", " ", " ", "\n"]) for w in words).strip()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, very long and repeated texts, repeated rows, and columns whose names operators use inside."""
    r = random.Random(11)
    base = prose(r, 120)
    words = base.split(" ")
    near = " ".join([*words[:50], "changed", *words[51:]])
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one two three"), (9, "éèê ñandú Straße ΟΔΟΣ 日本語 🙂 é"),
        (10, "same line\nsame line\nsame lime\nother"), (11, "a" * 70_000), (12, prose(r, 30_000)), (13, "<|endoftext|> it's 's <|startoftext|>"), (14, base), (14, base), (15, "!!! ### ???"),
        (None, prose(r, 40)), (16, "x y z\u0085\x1c\x0b\x0c\r\n"),
    ]
    inside = ["tie", "key", "c", "n", "h", "at", "pii_pattern", "pii_found", "pii_made", "_pii_found", "PII_MADE_1", "lines_doc", "lines_gone", "_lines_gone", "n_lines", "n_removed", "length", "row", "salt", "place", "size", "m", "k"]
    rows = [(d, t, "en", "s", len(t or ""), "X", 1, [1], True, "h", *["keep"] * len(inside)) for d, t in texts]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, doc string, i int, bits array<int>, halo boolean, task string"
    return spark.createDataFrame(rows, ", ".join([kinds, *(f"`{c}` string" for c in inside)])), texts


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward[0].where("doc_id = -1")


LETTERS = string.ascii_letters
