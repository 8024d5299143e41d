"""Plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, size):
    w = WORD.findall(ascii_lower(t))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_links(sets, percent):
    ids = [i for i in sets if sets[i]]
    at = {}
    for i in ids:
        for s in sets[i]:
            at.setdefault(s, []).append(i)
    for i in ids:
        seen = {}
        for s in sets[i]:
            for j in at[s]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                yield i, j
