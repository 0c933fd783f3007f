"""Texts for the tests of this folder."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "pra", "té", "zo", "ri", "sho"]
    return ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n)]


def lines(words: list[str], per_line: int = 9) -> str:
    return "\n".join(" ".join(words[k:k + per_line]) + "." for k in range(0, len(words), per_line))
