"""Small tables with what operators must bear, and brute-force helpers."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n int, kept boolean, row string, copy int"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None, low: bool = True) -> list[str]:
    return WORD.findall(lower(text or "") if low else text or "")


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


def documents(spark, texts: list, ids: list | None = None):
    """Rows of documents with extra columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}" if k % 7 else None, len(t or ""), 7, 8, True, "x", 9) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed: int = 5) -> list:
    """Prose with near copies of growing distance, exact copies, odd white space and empty texts."""
    rng = random.Random(seed)
    out: list = [None, "", " \n\t ", "one", "One", "two words", "é ü ß €", "a b c d", "a b c d e", "A  b\tc\nd e"]
    for _ in range(12):
        base = prose(rng, rng.choice([30, 80, 200])).split(" ")
        out.append(" ".join(base))
        for edits in (0, 1, 2, 3, 5, 9, 14):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out.append(prose(rng, 30_000))
    return out


def components(texts: list, ids: list, percent: int = 75) -> dict:
    """doc_id to the least id reachable, by all pairs."""
    sets = {i: shingles(t) for i, t in zip(ids, texts, strict=True)}
    inverted: dict = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    both: Counter = Counter()
    for own in inverted.values():
        both.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
