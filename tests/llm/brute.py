"""Brute-force versions that several tests share."""

import re


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def links(texts, n, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}
