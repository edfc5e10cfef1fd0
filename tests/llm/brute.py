"""Slow, plain versions that tests compare the operators with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from scriptorium.llm import language


def phrases(text: bytes, known: bytes) -> int:
    """Greedy longest matches of a normalised stretch in a sample."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        n, i = n + 1, i + k
    return n


def stretches(text: bytes) -> list[bytes]:
    marks = [0]
    for k in range(1, max(1, -(-len(text) // language.STRETCH))):
        at = text.find(0, k * language.STRETCH)
        marks.append(len(text) if at < 0 else at)
    return [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]


def classes(text: str) -> bytes:
    """A text in lower case, as the bytes' classes: letters 1 to 26, other bytes from 128 on from 27 on,
    a run of all else 0."""
    low = "".join(c.lower() if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" else c for c in text)
    raw = [b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in low.encode()]
    return bytes(b for k, b in enumerate(raw) if b or k == 0 or raw[k - 1])


def components(items: list, shingle: int, percent: int) -> dict:
    """id -> smallest id reachable over links, for larger inputs: by an index of shingles."""
    sets = {}
    for i, text in items:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    posted, up = defaultdict(list), {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in posted[x])
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            posted[x].append(i)
    return {i: find(i) for i in sets}
