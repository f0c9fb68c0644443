"""Rows with the awkward cases: NULLs, empty and very long texts, repeated rows, clashing column names."""

import random

#: Names the operators use inside, as further columns of their input.
CLASHING = "row string, place string, line string, h string, key string, size string, part string, node string, root string, score string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(draw.choice("abcdefghij") for _ in range(2)) + str(draw.randrange(vocabulary))
        out.append(word + (draw.choice([".", ",", "\n", ".\n"]) if i % 11 == 10 else ""))
    return " ".join(out)


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id"), (4, prose(1, 80)), (4, prose(1, 80)), (5, prose(1, 80)),
    (6, "one"), (7, "é ñ 　漢字 x́ <|endoftext|>"), (8, prose(2, 30_000)), (9, "\n".join(["the same line again here"] * 50)),
    (4, prose(3, 60)), (None, None), (10, "a\x00b   c"),
]
