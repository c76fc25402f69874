"""Plain Python versions of the operators, as slow and as clear as can be."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return [w for w in SPACES.split((text or "").encode()) if w]


def simhash(text: str | None, width: int = 4) -> int:
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fingerprints: list[int], radius: int) -> list[int]:
    """The index of the first of each one's component."""
    group = list(range(len(fingerprints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fingerprints):
            for j, b in enumerate(fingerprints):
                if (a ^ b).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def without_windows(docs: list[tuple[int | None, str | None]], k: int) -> list[tuple]:
    """(key, words, removed, sha256 of what is kept) of each row."""
    least: dict[tuple, int] = {}
    for key, text in docs:
        found = words(text)
        for i in range(len(found) - k + 1):
            if key is not None:
                window = tuple(found[i : i + k])
                least[window] = min(key, least.get(window, key))
    out = []
    for key, text in docs:
        found = words(text)
        gone = {j for i in range(len(found) - k + 1) if key is not None and least[tuple(found[i : i + k])] < key for j in range(i, i + k)}
        kept = b" ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((key, len(found), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def without_runs(docs: list[tuple[int, str | None]], least: int) -> dict[int, str | None]:
    """Texts by key, less each later copy of ``least`` lines in a row."""
    place: dict[tuple, tuple] = {}
    out = {}
    solid = {key: [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\x0b\f")] if text is not None else [] for key, text in docs}
    for key in sorted(solid):
        for p in range(len(solid[key]) - least + 1):
            place.setdefault(tuple(x for _, x in solid[key][p : p + least]), (key, p))
    for key, text in docs:
        own, gone = solid[key], set()
        for p in range(len(own) - least + 1):
            if place[tuple(x for _, x in own[p : p + least])] < (key, p):
                gone |= {i for i, _ in own[p : p + least]}
        out[key] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def maximal_runs(docs: list[tuple[int | None, str | None]], least: int) -> dict[int | None, list[tuple[int, int]]]:
    """By key the stretches (start, lines) that occur elsewhere too and lie in no longer such stretch."""
    solid = {key: [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\f")] for key, text in docs}
    times, size = Counter(), 1
    longest = {(key, p): 0 for key, own in solid.items() for p in range(len(own))}
    alive = list(longest)
    while alive:
        runs = {(key, p): tuple(solid[key][p : p + size]) for key, p in alive if p + size <= len(solid[key])}
        times = Counter(runs.values())
        alive = [at for at, run in runs.items() if times[run] > 1]
        for at in alive:
            longest[at] = size
        size += 1
    out = {}
    for key, own in solid.items():
        end, out[key] = 0, []
        for p in range(len(own)):
            if longest[key, p] and p + longest[key, p] > end:
                end = p + longest[key, p]
                if longest[key, p] >= least:
                    out[key].append((p, longest[key, p]))
    return out


def tiles(item: list, text: list, shortest: int) -> int:
    """Tokens of ``item`` under a greedy string tiling."""
    a, b = [False] * len(item), [False] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return total
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n
        total += n


def pieces(word: str, vocabulary: set[str]) -> int | None:
    """Pieces of greedy longest match."""
    at = found = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return None
        at, found = end, found + 1
    return found


def cross_entropies(rows: list[tuple[int | None, str | None]], target: set[int], mu: float) -> list[tuple | None]:
    """(words, loss under the target, loss under all) of each row, itself left out; None without words."""
    sequences = [[b"<s>", *[w for w in words((t or "").lower())], b"</s>"] if words(t) else [] for _, t in rows]
    vocabulary = {w for s in sequences for w in s[1:]}

    def loss(i: int, members: list[int]) -> float:
        rest = [sequences[j] for j in members if j != i]
        one, two = Counter(w for s in rest for w in s), Counter(p for s in rest for p in zip(s, s[1:]))
        n = sum(len(s) - 1 for s in rest if s)
        own = sequences[i]
        each = [-math.log((two[v, w] + mu * (one[w] + 1) / (n + len(vocabulary))) / (one[v] + mu)) for v, w in zip(own, own[1:])]
        return sum(each) / len(each)

    good = [i for i, (k, _) in enumerate(rows) if k in target]
    return [(len(s) - 2, loss(i, good), loss(i, list(range(len(rows))))) if s else None for i, s in enumerate(sequences)]


def verdict(url: str | None, rules: list[tuple[str, str, str]]) -> tuple:
    """(host, path, rule, verdict)."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def dot_product_bin(open_: dict[int, tuple], capacity: tuple) -> list[int]:
    """Fills one bin from ``open_``, by the largest dot product of demand and what is left, weighted by inverse capacities."""
    left, out = list(capacity), []
    while True:
        fits = [i for i, need in open_.items() if all(n <= x for n, x in zip(need, left))]
        if not fits or left[0] <= 0:
            return out
        best = max(fits, key=lambda i: (sum(n * x / c**2 for n, x, c in zip(open_[i], left, capacity)), -i))
        left = [x - n for n, x in zip(open_.pop(best), left)]
        out.append(best)
