"""Texts that every operator has to cope with, and brute-force versions."""

import random
from collections import Counter

WORDS = "the of and blue green stone river ship lantern copper winter summer road tower music".split()


def prose(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(words))


def changed(text: str, every: int, seed: int = 0) -> str:
    """The text with one word in ``every`` replaced."""
    rng = random.Random(seed)
    words = text.split(" ")
    for at in range(rng.randrange(every), len(words), every):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties and repeated rows."""
    base, other = prose(1), prose(2, 300)
    long = " ".join(prose(n, 200) for n in range(40))
    rows = [
        (1, base), (2, base), (3, changed(base, 40, 1)), (4, changed(base, 10, 2)), (5, None), (6, ""),
        (7, "   \n\t "), (8, "word"), (9, "WORD"), (10, "é ñ ß 日本 \U0001f600"), (11, other), (12, other),
        (13, other + " tail"), (14, long), (15, long[:5000] + " cut"), (16, "aa " * 400), (None, base),
        (None, None), (17, "x" * 700), (17, "other text under the same identifier"), (18, prose(3)),
        (18, prose(3)), (19, "It's <|endoftext|> a  test\n\n of\tspaces "), (20, "Licensed under CC BY-NC 4.0."),
        (21, "one two"), (22, "one two three four five six seven eight nine ten eleven"),
    ]
    return rows


def shingles(text: str | None) -> frozenset:
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 2:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(words, words[1:], strict=False))


def components(sets: dict[int, list[frozenset]]) -> dict[int, int]:
    """Least reachable identifier; an identifier with several texts has several sets."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= 80 * len(a | b):
                        x, y = root(i), root(j)
                        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def covered(texts: list[str | None], width: int) -> list[bytearray]:
    """For every text, which bytes a string of ``width`` bytes covers that starts elsewhere too."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        flags = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                flags[i : i + width] = b"\1" * width
        out.append(flags)
    return out
