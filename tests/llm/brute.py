"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def targets(sizes, budget):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], weight[s] * level) for s in names) < budget else (low, level)
    return {s: min(2 * sizes[s], weight[s] * high) for s in names}


def quality(text):
    ws, text = words(text), text or ""
    seen, repeats = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7)), set()
    for i in range(len(ws) - 7):
        if seen[tuple(ws[i : i + 8])] > 1:
            repeats.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeats),
        "base_failed": len(ws) < 20 or 100 * len(repeats) > 30 * len(ws),
    }


def check_places(packed, capacity):
    for _, rows in packed.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.length.sum() <= capacity
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]


def backoff(ids, order, alpha, min_count):
    counts = Counter()
    for t in ids.values():
        for k in range(1, order + 1):
            counts.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    total = sum(map(len, ids.values()))
    out = {}
    for d, t in ids.items():
        score, back = 0.0, 0
        for i in range(len(t)):
            reach = min(i, order - 1)
            for k in range(reach, 0, -1):
                if counts[tuple(t[i - k : i + 1])] >= min_count:
                    value = counts[tuple(t[i - k : i + 1])] / counts[tuple(t[i - k : i])]
                    break
            else:
                k, value = 0, counts[(t[i],)] / total
            score += math.log(value) + (reach - k) * math.log(alpha)
            back += k < reach
        out[d] = (len(t), back, score)
    return out


def shingles(text, size):
    ws = words((text or "").translate(LOWER))
    if len(ws) < size:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def components(texts, size, num, den):
    """``key: (set size, smallest linked key)`` of distinct keys."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in sets.items():
        common = Counter(j for g in s for j in holders[g] if j < k)
        for j, o in common.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def removed_lines(texts, min_words):
    """``key: places of removed lines``, over documents in the order of their keys."""
    runs, out = {}, {}
    for k in sorted(texts):
        lines = [(p, line, len(words(line))) for p, line in enumerate((texts[k] or "").split("\n")) if words(line)]
        gone = set()
        found = []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(w for _, _, w in lines[i:j]) >= min_words:
                    found.append((i, j))
        for i, j in found:
            body = tuple(line for _, line, _ in lines[i:j])
            first = runs.setdefault(body, (k, i))
            if first != (k, i):
                gone.update(p for p, _, _ in lines[i:j])
        out[k] = sorted(gone)
    return out
