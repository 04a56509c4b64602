"""Brute-force versions for small tables."""

from __future__ import annotations

import hashlib

import numpy as np


def repeated_strings(texts: dict[int, str | None], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for small tables: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - width + 1):
            if raw[s : s + width] in seen:
                gone[s : s + width] = True
            else:
                seen.add(raw[s : s + width])
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(raw) else 0))
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def near_classes(texts: dict[int, str | None], percent: int = 85, width: int = 5) -> dict[int, tuple[int, int, bool]]:
    """(n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    import re

    sets = {}
    for doc, text in texts.items():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[doc] = {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} or ({tuple(found)} if found else set())
    owners: dict = {}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc in sorted(sets):
        common: dict = {}
        for s in sets[doc]:
            for other in owners.setdefault(s, []):
                common[other] = common.get(other, 0) + 1
            owners[s].append(doc)
        for other, n in common.items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def kept_lines(texts: dict[int, str | None], min_docs: int) -> dict[int, tuple[int, int, str]]:
    """(lines, dropped lines, text left) by counting keys in a dictionary."""
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    seen: dict = {}
    for doc, text in texts.items():
        for k in {key(x) for x in (text or "").split("\n")}:
            seen.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        stay = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out[doc] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def best_alignment(text: list[str], item: list[str]) -> int:
    """Smith-Waterman by its definition: match 2, mismatch -1, gap -1."""
    best, above = 0, [0] * (len(text) + 1)
    for word in item:
        row = [0]
        for j, other in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (2 if other == word else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def tree_scores(tokens: dict[int, list[str]], held: dict[int, bool], depth: int, min_context: int, min_next: int, discount: float, gain: float) -> dict[int, float]:
    """log10 probabilities of token lists by a suffix tree in dictionaries, from the definition."""
    import math
    from collections import Counter, defaultdict

    word = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, distinct = sum(word.values()), len(word)
    after: dict = defaultdict(Counter)
    for d, ws in tokens.items():
        if not held[d]:
            for i in range(len(ws)):
                for k in range(1, depth + 1):
                    if i >= k:
                        after[tuple(ws[i - k : i])][ws[i]] += 1
    occurs: Counter = Counter()
    for d, ws in tokens.items():
        if not held[d]:
            for k in range(1, depth + 1):
                for i in range(len(ws) - k + 1):
                    occurs[tuple(ws[i : i + k])] += 1
    kept: dict = {}

    def chance(context, w):
        p = (word[w] + 1) / (total + distinct + 1)
        for k in range(1, len(context) + 1):
            c = context[len(context) - k :]
            if c in kept:
                n = after[c][w] if word[w] >= min_next else 0
                p = (n - discount if n >= 2 else 0.0) / occurs[c] + kept[c] * p
        return p

    for k in range(1, depth + 1):
        level = {}
        for c in (c for c in after if len(c) == k and occurs[c] >= min_context):
            seen = {w: n for w, n in after[c].items() if n >= 2 and word[w] >= min_next}
            if sum((n - 1) * math.log((n - discount) / occurs[c] / chance(c[1:], w)) for w, n in seen.items()) >= gain:
                level[c] = 1 - sum(n - discount for n in seen.values()) / occurs[c]
        kept.update(level)
    return {d: sum(math.log10(chance(tuple(ws[max(0, i - depth) : i]), ws[i])) for i in range(len(ws))) for d, ws in tokens.items()}
