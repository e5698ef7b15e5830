"""Plain versions of the text operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


class Groups(dict):
    """Union of names; the least names a group."""

    def __missing__(self, x):
        self[x] = x
        return x

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_groups(rows, size, percent):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    where, groups = defaultdict(list), Groups()
    for i in sorted(sets):
        common = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                common[j] += 1
            where[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


_FORMS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal_spans(text):
    out = []
    for kind, form in enumerate(_FORMS):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and _luhn(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def top_k(vectors, is_query, k, scale=256.0):
    import math

    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    usable = [(i, whole(v)) for i, v in vectors if i is not None and whole(v) is not None]
    rows = []
    for i, q in usable:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in usable if j != i)
            rows += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(rows)


def repeated_words(texts, width):
    """Runs of ``width`` words that stand in more than one text."""
    seen = defaultdict(set)
    for i, text in texts:
        words = (text or "").split()
        for j in range(len(words) - width + 1):
            seen[tuple(words[j : j + width])].add(i)
    return {g for g, docs in seen.items() if len(docs) > 1}
